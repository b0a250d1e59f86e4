"""A term index of chunks as a Spark table, and rankings that read little of it.

The table holds postings in blocks: a row is one block of one term, with the least
and greatest term frequency and length of its chunks, and the postings themselves
as an array. Blocks hold postings of like frequency, so that the few chunks that
use a term often can be read without the many that use it once. A term of any size
is many blocks of bounded size. The table is partitioned by a hash of the term:
questions read the partitions of their own terms only.

Postings become blocks where their chunks are read, a segment of bounded size at a
time: neither texts nor postings are shuffled or written before they are in the
table. Only chunks whose id repeats are summed up over all tasks first.

A search reads block headers first. The best blocks of each term give a lower
bound of the score that enters the top k; then only blocks are read whose greatest
possible score reaches it. What is dropped cannot be in the result, so rankings
are exact.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.functions import text as fx
from citeline.functions.arrow import bounded_batches, pieces
from citeline.operators.scoring import DECIMALS
from citeline.session import settle

#: Partitions of the table, and postings of a block, about.
PARTS, BLOCK = 64, 256
#: Postings that a task makes into blocks at a time, about, and of a batch of blocks.
SEGMENT, SENT = 2_000_000, 500_000
#: Bytes of a row group, so that the blocks of a frequent term are read by many tasks.
GROUP_BYTES = 8 * 1024 * 1024
#: Sums of a question and a chunk that one task holds, about.
SUMS = 1_000_000
#: Frequencies whose score is looked up rather than summed up.
LISTED = 256
#: Frequencies above which blocks are not parted by frequency any more.
LEVELS = 8
#: What two sums of the same terms may differ by, added in different orders.
SLACK = 1e-7
#: What names a block in the table.
PLACE = ["part", "term", "level", "number"]


@dataclass
class TermIndex:
    """Where the blocks lie, and what scores need of the whole corpus."""

    path: str
    schema: T.StructType
    terms: DataFrame
    chunks: int
    mean_length: float
    cut_question: Callable[[Column], Column] = fx.query_terms

    def blocks(self, spark) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


@dataclass
class _Postings:
    """Of some chunks: what each posting holds, by place."""

    chunk_id: pa.Array
    term: pa.DictionaryArray
    tf: np.ndarray
    length: np.ndarray


def _of_words(batch: pa.RecordBatch) -> Iterator[_Postings]:
    """Postings of chunks, each a row with the list of its words."""
    for rows in pieces(batch, "words"):
        lists = rows.column("words")
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        words = lists.flatten().dictionary_encode()
        width = max(1, len(words.dictionary))
        at = np.repeat(np.arange(len(length)), length)
        held, tf = np.unique(at * width + words.indices.to_numpy(), return_counts=True)
        at, code = held // width, held % width
        term = pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), words.dictionary)
        yield _Postings(rows.column("chunk_id").take(pa.array(at)), term, tf.astype(np.int32), length[at])


def _of_counts(batch: pa.RecordBatch) -> Iterator[_Postings]:
    """Postings that are rows already."""
    tf, length = (batch.column(c).to_numpy() for c in ("tf", "length"))
    yield _Postings(batch.column("chunk_id"), batch.column("term").dictionary_encode(), tf, length)


def _packed(postings: Callable[[pa.RecordBatch], Iterator[_Postings]], block: int):
    """Rows into blocks, segment by segment. No more than a segment and a piece is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, segment = [], 0, TaskContext.get().partitionId() << 16
        for batch in batches:
            for some in postings(batch):
                held.append(some)
                n += len(some.tf)
                if n >= SEGMENT:
                    yield from _segment(held, block, segment)
                    held, n, segment = [], 0, segment + 1
        if n:
            yield from _segment(held, block, segment)

    return run


def _segment(held: list[_Postings], block: int, segment: int) -> Iterator[pa.RecordBatch]:
    """One row per block of the postings. Blocks of a term and level are numbered within
    the segment, and segments over all tasks."""
    term = pa.chunked_array([x.term for x in held]).unify_dictionaries().combine_chunks()
    ids = pa.chunked_array([x.chunk_id for x in held]).combine_chunks()
    tf, length = (np.concatenate([getattr(x, c) for x in held]) for c in ("tf", "length"))
    # terms in order, the postings of a term by level
    named = pc.array_sort_indices(term.dictionary).to_numpy()
    place = np.empty(len(named), np.int64)
    place[named] = np.arange(len(named))
    key = place[term.indices.to_numpy()] * (LEVELS + 1) + np.minimum(tf, LEVELS)
    order = np.argsort(key, kind="stable")
    key = key[order]
    begins = np.flatnonzero(np.diff(key, prepend=-1))
    size = np.diff(begins, append=len(key))
    # a group is cut into as many blocks as it needs, of like size
    many = -(-size // block)
    group = np.repeat(np.arange(len(begins)), many)
    number = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
    first = begins[group] + number * size[group] // many[group]
    ends = np.append(first[1:], len(key))
    at = 0
    while at < len(first):
        last = max(at + 1, int(np.searchsorted(ends, first[at] + SENT, side="right")))
        rows, start = order[first[at] : ends[last - 1]], first[at:last] - first[at]
        own = key[first[at:last]]
        each = [ids.take(pa.array(rows)), pa.array(tf[rows]), pa.array(length[rows])]
        yield pa.RecordBatch.from_arrays(
            [
                term.dictionary.take(pa.array(named[own // (LEVELS + 1)])),
                pa.array(own % (LEVELS + 1), pa.int32()),
                pa.array((segment << 24) + number[at:last], pa.int64()),
                pa.array(np.maximum.reduceat(tf[rows], start), pa.int32()),
                pa.array(np.minimum.reduceat(length[rows], start), pa.int32()),
                pa.array(ends[at:last] - first[at:last], pa.int64()),
                pa.array(np.add.reduceat(tf[rows].astype(np.int64), start), pa.int64()),
                pa.ListArray.from_arrays(
                    pa.array(np.append(start, len(rows)), pa.int32()),
                    pa.StructArray.from_arrays(each, ["chunk_id", "tf", "length"]),
                ),
            ],
            names=["term", "level", "number", "most_tf", "least_length", "n", "uses", "postings"],
        )
        at = last


def _blocks(chunks: DataFrame, block: int, cut: Callable[[Column], Column]) -> DataFrame:
    """The rows of the index. Unless ids repeat, they are made where the chunks lie."""
    schema = T._parse_datatype_string(
        "term string, level int, number long, most_tf int, least_length int, n long, uses long,"
        " postings array<struct<chunk_id: long, tf: int, length: int>>"
    )
    schema["postings"].dataType.elementType["chunk_id"].dataType = chunks.schema["chunk_id"].dataType
    words = chunks.select("chunk_id", cut(F.coalesce("content", F.lit(""))).alias("words"))
    repeated = settle(chunks.groupBy("chunk_id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("chunk_id").alias("again")))
    if repeated.isEmpty():
        blocks = bounded_batches(words).mapInArrow(_packed(_of_words, block), schema)
    else:
        same = F.col("chunk_id").eqNullSafe(F.col("again"))
        once = words.join(repeated, same, "left_anti")
        several = words.join(repeated, same, "left_semi")
        each = several.select("chunk_id", F.size("words").alias("length"), F.explode("words").alias("term"))
        counts = each.groupBy("term", "chunk_id").agg(F.count("*").cast("int").alias("tf"), F.first("length").alias("length"))
        blocks = bounded_batches(once).mapInArrow(_packed(_of_words, block), schema)
        blocks = blocks.unionAll(counts.mapInArrow(_packed(_of_counts, block), schema))
    return blocks.withColumn("part", _part(F.col("term")))


def write_index(
    chunks: DataFrame,
    path: str,
    block: int = BLOCK,
    cut: Callable[[Column], Column] = fx.tokens,
    cut_question: Callable[[Column], Column] = fx.query_terms,
) -> TermIndex:
    """Index chunk_id and content. The folder must be new; ``terms`` of the
    result holds (term, df). Null contents have no terms. Rows of the same id are one
    chunk to a posting. ``cut`` makes the tokens of a content, ``cut_question`` the
    different ones of a question."""
    placed = _blocks(chunks, block, cut)
    placed.write.partitionBy("part").option("parquet.block.size", GROUP_BYTES).option("compression", "zstd").parquet(path)
    index = TermIndex(path, placed.schema, None, chunks.count(), 0.0, cut_question)
    spark = chunks.sparkSession
    index.terms = index.blocks(spark).groupBy("term").agg(F.sum("n").alias("df"))
    uses = index.blocks(spark).agg(F.sum("uses").alias("w")).first()["w"] or 0
    index.mean_length = uses / max(1, index.chunks)
    return index


def _mean_reciprocals(index: TermIndex) -> Callable[..., Column]:
    """The engine's lexical score: 1 + 1/4 + ... + 1/tf^2, over the question's terms."""
    first = F.array(*[F.lit(float(x)) for x in np.cumsum(1.0 / np.arange(1, LISTED + 1) ** 2)])

    def score(tf, length, df, n):
        summed = F.aggregate(F.sequence(F.lit(1), tf), F.lit(0.0), lambda held, i: held + F.lit(1.0) / (i * i))
        return F.when(tf <= LISTED, F.get(first, tf - 1)).otherwise(summed) / n

    return score


def bm25(index: TermIndex, k1: float = 1.2, b: float = 0.75) -> Callable[..., Column]:
    """The usual formula, with an inverse document frequency that is never negative."""

    def score(tf, length, df, n):
        idf = F.log1p((F.lit(float(index.chunks)) - df + 0.5) / (df + 0.5))
        norm = F.lit(k1 * (1 - b)) + F.lit(k1 * b / max(index.mean_length, 1e-9)) * length
        return idf * tf * (k1 + 1) / (tf + norm)

    return score


def asked_terms(questions: DataFrame, cut: Callable[[Column], Column] = fx.query_terms) -> DataFrame:
    """(question_id, term, n): the different terms of each question."""
    listed = questions.select("question_id", cut(F.col("question")).alias("terms"))
    return listed.select("question_id", F.explode("terms").alias("term"), F.size("terms").alias("n"))


def _limits(index: TermIndex, asked: DataFrame, score: Callable[..., Column], k: int) -> DataFrame:
    """(question_id, term, n_terms, times, df, least): the terms of each question that the
    index holds, how often it lists them, and the score that a block of the term must be
    able to reach if it is to hold one of the question's k best chunks."""
    listed = asked.where("question_id IS NOT NULL").groupBy("question_id", "term", F.col("n").alias("n_terms"))
    listed = settle(listed.agg(F.count("*").alias("times")))  # as many rows as questions have words
    blocks = _of_parts(index, listed)
    asked_for = blocks.join(F.broadcast(listed.select("term").distinct()), "term", "left_semi")
    known = settle(listed.join(asked_for.groupBy("term").agg(F.sum("n").alias("df")), "term"))
    slot = ["question_id", "term", "n_terms"]
    best = Window.partitionBy(*slot).orderBy(F.col("bound").desc(), "level", "number")
    # the best blocks of a term that hold k postings: no more than k of them
    top = _heads(blocks, known, score).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
    first = top.withColumn("upto", F.sum("held").over(best.rowsBetween(Window.unboundedPreceding, -1)))
    first = settle(first.where(F.coalesce("upto", F.lit(0)) < k))
    # only those blocks' postings meet the questions
    few = blocks.select(*PLACE, "postings").join(F.broadcast(first.select(*PLACE).distinct()), PLACE, "left_semi")
    scores = few.join(first, PLACE).select("question_id", "df", "n_terms", "times", F.inline("postings"))
    reached = (
        scores.withColumn("score", score(F.col("tf"), F.col("length"), F.col("df"), F.col("n_terms")) * F.col("times"))
        .groupBy("question_id", "chunk_id")
        .agg(F.sum("score").alias("score"))
    )
    order = Window.partitionBy("question_id").orderBy(F.col("score").desc())
    # the k-th best of what is surely reached; questions with fewer have no bound
    enters = (
        reached.withColumn("place", F.row_number().over(order))
        .where(F.col("place") == k)
        .select("question_id", F.col("score").alias("enters"))
    )
    tops = first.where("place = 1").select(*slot, "times", "df", F.col("bound").alias("top"))
    sums = tops.groupBy("question_id").agg(F.sum("top").alias("all_tops"))
    least = F.col("enters") - SLACK - F.col("all_tops") + F.col("top")
    return (
        tops.join(sums, "question_id")
        .join(enters, "question_id", "left")
        .select(*slot, "times", "df", F.coalesce(least, F.lit(float("-inf"))).alias("least"))
    )


def needed_blocks(index: TermIndex, asked: DataFrame, score: Callable[..., Column], k: int) -> DataFrame:
    """(question_id, term, level, number): the blocks that may hold one of the
    question's k best chunks.

    ``score`` must grow with the frequency and fall with the length of a chunk."""
    limits = settle(_limits(index, asked, score, k))
    heads = _heads(_of_parts(index, limits), limits, score)
    return heads.where(F.col("bound") >= F.col("least")).select("question_id", *PLACE, "df", "n_terms")


def _of_parts(index: TermIndex, terms: DataFrame) -> DataFrame:
    """Blocks from the partitions that hold the terms."""
    parts = [r["part"] for r in terms.select(_part(F.col("term")).alias("part")).distinct().collect()]
    return index.blocks(terms.sparkSession).where(F.col("part").isin(parts))


def _heads(blocks: DataFrame, known: DataFrame, score: Callable[..., Column]) -> DataFrame:
    """Headers of the blocks of each question's terms, and the most that a chunk of the
    block can have of the term; postings are not read."""
    headers = blocks.select(*PLACE, "most_tf", "least_length", F.col("n").alias("held"))
    bound = score(F.col("most_tf"), F.col("least_length"), F.col("df"), F.col("n_terms")) * F.col("times")
    return headers.join(F.broadcast(known), "term").withColumn("bound", bound)


def ranked(index: TermIndex, questions: DataFrame, k: int = 20, score=None) -> DataFrame:
    """(question_id, chunk_id, rank, score): the k best chunks of each question,
    ties by chunk id. ``score`` is made of the index; the engine's own by default.

    Questions without a known term have no rows. Only blocks that may hold a
    result are read, from the partitions of the questions' terms, each once: they are
    picked where they lie, by the least score that any question needs of the term. Their
    postings are dealt by chunk before they meet the questions, so what is shuffled
    does not grow with these, and a task sums up all of its chunks. A question may
    meet a posting that only another one needs: its sums are whole then, too.
    """
    made = (score or _mean_reciprocals)(index)
    # a question that is repeated counts as often
    limits = settle(_limits(index, asked_terms(questions, index.cut_question), made, k))
    many = limits.select("question_id").distinct().count()
    tasks = max(questions.sparkSession.sparkContext.defaultParallelism, -(-index.chunks * many // SUMS))
    wants = limits.groupBy("term", "df", "n_terms", "times").agg(F.min("least").alias("least"))
    wants = wants.groupBy("term", "df").agg(F.collect_list(F.struct("n_terms", "times", "least")).alias("wants"))
    # a number in place of the term, as that is shuffled with each posting
    wants = settle(wants.withColumn("key", F.monotonically_increasing_id()))

    def reaches(want):
        return made(F.col("most_tf"), F.col("least_length"), F.col("df"), want["n_terms"]) * want["times"] >= want["least"]

    postings = (
        _of_parts(index, limits)
        .select("term", "most_tf", "least_length", "postings")
        .join(F.broadcast(wants), "term")
        .where(F.exists("wants", reaches))
        .select("key", F.inline("postings"))
        .repartition(tasks, "chunk_id")
    )
    terms = limits.join(wants.select("term", "key"), "term").select("question_id", "key", "df", "n_terms", "times")
    value = made(F.col("tf"), F.col("length"), F.col("df"), F.col("n_terms")) * F.col("times")
    scored = postings.join(F.broadcast(terms), "key").select("question_id", "chunk_id", value.alias("score"))
    sums = scored.groupBy("question_id", "chunk_id").agg(F.sum("score").alias("score"))
    order = Window.partitionBy("question_id").orderBy(F.round("score", DECIMALS).desc(), "chunk_id")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("question_id", "chunk_id", "rank", "score")
