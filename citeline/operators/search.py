"""Retrieval: scope, candidate rankings, fusion, and the hits themselves."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from citeline.config import DEFAULTS
from citeline.functions import text as fx
from citeline.functions.arrow import bounded_batches, pieces
from citeline.operators.scoring import (
    DECIMALS,
    LEXICAL,
    TRANSLATED,
    VECTOR,
    Held,
    QuestionBlock,
    Words,
    score_chunks,
)
from citeline.session import settle


def scope_to_product(
    chunks: DataFrame, links: DataFrame, product_id, manual: str = "manual_id"
) -> DataFrame:
    """Chunks one product may be answered from: its documents are linked to the
    product, and the passage applies to it (NULL: to every linked product)."""
    if product_id is None:
        return chunks
    covered = links.where(F.col("product_id") == product_id).select(manual)
    applies = F.col("applies_to").isNull() | F.array_contains(
        "applies_to", F.lit(product_id)
    )
    return chunks.join(covered, manual, "left_semi").where(applies)


def attach_products(
    chunks: DataFrame, links: DataFrame, questions: DataFrame
) -> DataFrame:
    """Batch form of the scope: ``products`` lists, per chunk, the asked-about
    products it may answer. Only products that occur in ``questions`` count, so
    the list is no longer than the question set."""
    asked = questions.where("product_id IS NOT NULL").select("product_id").distinct()
    covers = (
        links.join(asked, "product_id", "left_semi")
        .groupBy("manual_id")
        .agg(F.collect_set("product_id").alias("products"))
    )
    scoped = F.when(F.col("applies_to").isNull(), F.col("products")).otherwise(
        F.array_intersect("products", "applies_to")
    )
    return chunks.join(settle(covers), "manual_id", "left").withColumn("products", scoped)


def _question_columns(questions: DataFrame, product: T.DataType) -> DataFrame:
    have = set(questions.columns)
    optional = {
        "vector": "array<float>",
        "terms": "array<string>",
        "translated_vector": "array<float>",
        "product_id": product,
    }
    return questions.select(
        "question_id",
        *[
            F.col(c) if c in have else F.lit(None).cast(t).alias(c)
            for c, t in optional.items()
        ],
    )


def _chunk_columns(chunks: DataFrame, rankings) -> DataFrame:
    have = set(chunks.columns)
    product = (
        chunks.schema["products"].dataType.elementType
        if "products" in have
        else T.StringType()
    )
    missing_tokens = LEXICAL not in rankings or "tokens" not in have
    if LEXICAL in rankings and "tokens" not in have:
        tokens = fx.tokens(F.col("content"))
    elif missing_tokens:
        tokens = F.lit(None).cast("array<string>")
    else:
        tokens = F.col("tokens")
    return chunks.select(
        "chunk_id",
        F.col("embedding")
        if "embedding" in have
        else F.lit(None).cast("array<float>").alias("embedding"),
        tokens.alias("tokens"),
        F.col("products")
        if "products" in have
        else F.lit(None).cast(T.ArrayType(product)).alias("products"),
    )


def _size() -> Column:
    """Bytes that a question takes in a block, about."""
    vectors = [8 * F.coalesce(F.size(c), F.lit(0)) for c in ("vector", "translated_vector")]
    terms = F.aggregate(
        F.coalesce("terms", F.array().cast("array<string>")), F.lit(0), lambda n, t: n + F.octet_length(t) + 8
    )
    return (vectors[0] + vectors[1] + terms).cast("long")


def question_blocks(asked: DataFrame, s=DEFAULTS) -> tuple[DataFrame, int]:
    """Questions with their ``__block``, and the number of blocks.

    Blocks are dealt by a hash; there are so many that the largest keeps the
    bounds in rows and bytes, both measured. A question that exceeds the bytes
    alone cannot be divided and shares its block with few others.
    """
    asked = settle(asked.withColumn("__size", _size()))
    total = asked.agg(
        F.count("*").alias("rows"), F.sum("__size").alias("bytes"), F.max("__size").alias("most")
    ).first()
    most = max(s.question_block_bytes, total["most"] or 0)
    n = max(1, -(-total["rows"] // s.question_block_rows), -(-(total["bytes"] or 0) // most))
    while True:
        placed = asked.withColumn("__block", F.pmod(F.xxhash64("question_id"), F.lit(n)).cast("int"))
        fullest = placed.groupBy("__block").agg(F.count("*").alias("rows"), F.sum("__size").alias("bytes")).agg(
            F.max("rows").alias("rows"), F.max("bytes").alias("bytes")
        ).first()
        within = (fullest["rows"] or 0) <= s.question_block_rows and (fullest["bytes"] or 0) <= 2 * most
        if within or n > 8 * total["rows"]:
            return placed, n
        n += max(1, n // 4)


def rank_candidates(
    chunks: DataFrame,
    questions: DataFrame,
    rankings: tuple[int, ...] = (VECTOR, LEXICAL, TRANSLATED),
    k: int = DEFAULTS.candidates,
    s=DEFAULTS,
) -> DataFrame:
    """Exact top k chunks per question for each ranking, in one pass.

    ``questions``: question_id, and of vector, terms, translated_vector,
    product_id those that apply. ``chunks``: chunk_id, embedding, content or
    tokens, and ``products`` when questions are scoped. Returns list_idx,
    question_id, chunk_id, score, similarity, rank (from 1).

    Questions are taken in blocks, bounded in rows and bytes, and as many blocks as
    keep the bound in bytes together are broadcast for one scan: chunks are read
    where they lie and never shuffled or copied. A task sends on only what may still
    be among the k best it has seen. The results of several scans are tables of their
    own, so that the driver and the workers hold the blocks of one scan at a time.
    """
    wide = _chunk_columns(chunks, rankings)
    product = wide.schema["products"].dataType.elementType
    asked = _question_columns(questions, product)
    fields = T.StructType(
        [
            T.StructField("list_idx", T.IntegerType()),
            T.StructField("question_id", asked.schema["question_id"].dataType),
            T.StructField("chunk_id", wide.schema["chunk_id"].dataType),
            T.StructField("score", T.DoubleType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    arrow = to_arrow_schema(fields)
    product_arrow = to_arrow_type(product)
    order = Window.partitionBy("list_idx", "question_id").orderBy(
        F.round("score", DECIMALS).desc(), "chunk_id"
    )
    placed, blocks = question_blocks(asked, s)
    scans = _scans(placed, s) if blocks > 1 else [[0]]
    found = []
    for numbers in scans:
        rows = placed.where(F.col("__block").isin(numbers)).drop("__size").collect()
        by_block = {}
        for r in rows:
            by_block.setdefault(r["__block"], []).append(r.asDict())
        shared = chunks.sparkSession.sparkContext.broadcast(
            [QuestionBlock.build(by_block[n], product_arrow) for n in sorted(by_block)]
        )

        def scan(batches, shared=shared):
            held = [Held(block, k) for block in shared.value]
            for batch in (piece for whole in batches for piece in pieces(whole, "tokens")):
                words = Words(batch.column("tokens")) if LEXICAL in rankings else None
                for block, best in zip(shared.value, held):
                    yield score_chunks(batch, block, rankings, k, arrow, best, words)

        best = bounded_batches(wide).mapInArrow(scan, fields)
        best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if len(scans) > 1:
            best = settle(best)
            shared.unpersist()
        found.append(best)
    return reduce(DataFrame.unionByName, found)


def _scans(placed: DataFrame, s=DEFAULTS) -> list[list[int]]:
    """Numbers of the blocks that share a scan."""
    sizes = placed.groupBy("__block").agg(F.sum("__size").alias("bytes")).orderBy("__block").collect()
    scans, held = [], 0
    for number, size in sizes:
        if not scans or held + size > s.question_block_bytes:
            scans.append([])
            held = 0
        scans[-1].append(number)
        held += size
    return scans


def vector_topk(chunks, questions, k=DEFAULTS.candidates, s=DEFAULTS) -> DataFrame:
    """Nearest chunks by cosine similarity, closest first."""
    return rank_candidates(chunks, questions, (VECTOR,), k, s).drop("list_idx", "score")


def lexical_topk(chunks, questions, k=DEFAULTS.candidates, s=DEFAULTS) -> DataFrame:
    """Chunks sharing at least one term, best term frequencies first; the
    similarity reported is that of the question's vector."""
    return rank_candidates(chunks, questions, (LEXICAL,), k, s).drop("list_idx")


def _first_seen() -> Column:
    return F.min(F.struct("list_idx", "rank")).alias("seen")


def reciprocal_rank_fusion(
    candidates: DataFrame, lists: int = 3, top_k: int = DEFAULTS.top_k, s=DEFAULTS
) -> DataFrame:
    """Merge ranked lists by position: sum of 1 / (60 + rank).

    The terms are added in list order, so equal sets of ranks give equal sums;
    ties keep the order in which the lists first show a chunk.
    """
    place = [
        F.max(F.when(F.col("list_idx") == i, 1.0 / (s.rrf_k + F.col("rank"))))
        for i in range(lists)
    ]
    fused = candidates.groupBy("question_id", "chunk_id").agg(
        *[p.alias(f"__t{i}") for i, p in enumerate(place)],
        F.max("similarity").alias("similarity"),
        _first_seen(),
    )
    score = reduce(
        lambda total, term: total + term,
        [F.coalesce(F.col(f"__t{i}"), F.lit(0.0)) for i in range(lists)],
    )
    order = Window.partitionBy("question_id").orderBy(
        F.col("score").desc(), "seen.list_idx", "seen.rank"
    )
    return (
        fused.select("question_id", "chunk_id", "similarity", "seen", score.alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
        .select("question_id", "rank", "chunk_id", "score", "similarity")
    )


def merge_hits(candidates: DataFrame, top_k: int = DEFAULTS.top_k) -> DataFrame:
    """Merge lists that share a scale: best similarity per chunk, then top k."""
    merged = candidates.groupBy("question_id", "chunk_id").agg(
        F.max("similarity").alias("similarity"), _first_seen()
    )
    order = Window.partitionBy("question_id").orderBy(
        F.round("similarity", DECIMALS).desc(), "seen.list_idx", "seen.rank"
    )
    return (
        merged.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top_k)
        .select("question_id", "rank", "chunk_id", "similarity")
    )


def fetch_hits(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Add the chunk's own columns to ranked ids. Ranking never carries text.

    The ranked ids are settled first: they are few, and with their size known
    the chunk table is read where it lies, not shuffled.
    """
    wanted = [
        c
        for c in ("chunk_id", "manual_id", "content", "page_from", "page_to", "language")
        if c in chunks.columns
    ]
    return chunks.select(*wanted).join(settle(ranked), "chunk_id").select(
        *ranked.columns, *wanted[1:]
    )


def context_text(hits: DataFrame) -> DataFrame:
    """Per question, the hits as the text a generator reads, best first."""
    part = F.concat(
        F.lit("[chunk "),
        F.col("chunk_id").cast("string"),
        F.lit(" · "),
        fx.page_label(F.col("page_from"), F.col("page_to")),
        F.lit("]\n"),
        F.col("content"),
    )
    parts = F.sort_array(F.collect_list(F.struct("rank", part.alias("part"))))
    return hits.groupBy("question_id").agg(
        F.concat_ws("\n\n", parts["part"]).alias("context")
    )


def hybrid_search(
    chunks: DataFrame,
    questions: DataFrame,
    links: DataFrame | None = None,
    top_k: int = DEFAULTS.top_k,
    s=DEFAULTS,
) -> DataFrame:
    """Vector, lexical and translated rankings fused; scoped where a question
    names a product. Ranked ids only: see ``fetch_hits``."""
    if links is not None:
        chunks = attach_products(chunks, links, questions)
    candidates = rank_candidates(chunks, questions, k=s.candidates, s=s)
    return reciprocal_rank_fusion(candidates, 3, top_k, s)


def semantic_search(
    chunks: DataFrame, questions: DataFrame, top_k: int = DEFAULTS.top_k, s=DEFAULTS
) -> DataFrame:
    """Two vector rankings, as asked and translated, merged by best score;
    neither lexical nor scoped."""
    unscoped = questions.drop("product_id")
    candidates = rank_candidates(chunks, unscoped, (VECTOR, TRANSLATED), s.candidates, s)
    return merge_hits(candidates, top_k)
