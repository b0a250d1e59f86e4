"""Scoring of whole texts by a language model learned from the corpus.

Three passes. The first counts the words of all training texts. The second writes
every text as subword ids, with its base score; ids are counted there. Words that are
frequent in the corpus (at most ``FREQUENT``) have their counts and ids in a table
that is sent to the workers; for all other words the counts are joined, so the
base score is exact whatever the size of the vocabulary. The attention model takes
its codes from the company that ids keep in all training texts, its starting
probabilities from the counts, and its weights are fitted on every token, in
rounds: parts of the corpus go on from the same weights, and the mean of theirs
begins the next. The last pass scores the ids of every text.
"""

import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.llm import attention, columns
from citeline.llm import words as W
from citeline.llm.tables import freed_shuffles, store
from citeline.llm.token_counts import file_path

#: Words whose counts and ids are sent to every worker, at most.
FREQUENT = 1 << 19
#: Bytes of text whose words are told apart at a time.
AT_ONCE = 1 << 21
#: Rounds that the way over the training texts is taken in.
ROUNDS = 4
#: Tokens of a part for one that it is to see: parts are dealt by hashes, which
#: leaves some a little short, and a short part is gone through twice.
ROOM = 1.125
#: Numbers of a vector that are summed in one row.
BLOCK = 1 << 12
FOLDS = 10
TOKENIZER = "byte_bpe_50k.json"
SMOOTH = 0.1


def held_out(doc_id: str) -> Column:
    """crc32 of the id as text, mod 10, is 0. A null id is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(True))


class Pieces:
    """Subword ids of single words, each as it stands after a space."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file_path(tokenizer))
        self.library.encode_special_tokens = True
        self.size = self.library.get_vocab_size()

    def __call__(self, words: list[bytes]) -> list[list[int]]:
        texts = [" " + w.decode() for w in words]
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]


_pieces: dict[str, Pieces] = {}


def pieces(tokenizer: str) -> Pieces:
    if tokenizer not in _pieces:
        _pieces[tokenizer] = Pieces(tokenizer)
    return _pieces[tokenizer]


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, hash, c): how often each word occurs, and the number that stands
    for it in Arrow tasks. Words are lower-cased in A-Z."""

    def run(batches):
        for batch in batches:
            for _, data, offsets in W.units(batch, text, AT_ONCE):
                words = W.split(data, offsets, W.SPACED_LOWER)
                number, distinct = words.codes
                yield pa.RecordBatch.from_arrays(
                    [
                        distinct.cast(pa.binary()).cast(pa.string()),
                        pa.array(words.names.view(np.int64)),
                        pa.array(np.bincount(number, minlength=len(distinct))),
                    ],
                    names=["word", "hash", "c"],
                )

    part = W.bounded_batches(docs.select(text)).mapInArrow(run, "word string, hash bigint, c bigint")
    return part.groupBy("word").agg(F.first("hash").alias("hash"), F.sum("c").alias("c"))


def _with_pieces(counted: DataFrame, tokenizer: str) -> DataFrame:
    """(word, hash, c, ids): ids as int32 bytes."""

    def run(batches):
        cut = pieces(tokenizer)
        for batch in batches:
            data, offsets = W.buffers(batch.column("word"))
            raw = data.tobytes()
            ids = cut([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            packed = [np.array(x, dtype=np.int32).tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packed, pa.binary())], names=[*batch.schema.names, "ids"])

    return W.bounded_batches(counted.select("word", "hash", "c")).mapInArrow(
        run, "word string, hash bigint, c bigint, ids binary"
    )


def _id_counts(cut: DataFrame, size: int, kind: type = np.int32) -> np.ndarray:
    """Corpus counts of all subword ids of words that occur ``c`` times, or of whole
    texts: one row per id reaches the driver."""
    each = "c" in cut.columns

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            data, offsets = W.buffers(batch.column("ids"))
            ids = np.frombuffer(data.tobytes(), dtype=kind)
            c = np.repeat(batch.column("c").to_numpy(zero_copy_only=False), np.diff(offsets) // ids.itemsize) if each else None
            total += np.bincount(ids, c, minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "c"])

    summed = W.bounded_batches(cut.select(*["c"] * each, "ids")).mapInArrow(run, "id bigint, c double").groupBy("id").agg(F.sum("c").alias("c"))
    out = np.zeros(size)
    for r in summed.collect():
        out[r["id"]] = r["c"]
    return out


@dataclass
class Frequent:
    """Counts and ids of the frequent words, by sorted word hash."""

    hashes: np.ndarray
    counts: np.ndarray
    first: np.ndarray
    ids: np.ndarray

    def cut(self, words: W.Words, tokenizer: str) -> "Cut":
        """The ids of all words; those that are not in the table are cut here."""
        index, distinct = words.codes
        keys = words.names
        place = np.searchsorted(self.hashes, keys)
        place[place == len(self.hashes)] = 0
        known = self.hashes[place] == keys if len(self.hashes) else np.zeros(len(keys), dtype=bool)
        rare = np.flatnonzero(~known)
        raw = distinct.take(pa.array(rare)).to_pylist()
        cut = pieces(tokenizer)(raw)
        # ids of the distinct words, one after the other: the frequent ones' and the others'
        begin = np.where(known, self.first[place] if len(self.hashes) else 0, 0)
        size = np.where(known, (self.first[place + 1] - self.first[place]) if len(self.hashes) else 0, 0)
        size[rare] = [len(x) for x in cut]
        begin[rare] = len(self.ids) + np.cumsum(size[rare]) - size[rare]
        flat = np.concatenate([self.ids, np.array([i for x in cut for i in x], dtype=np.int32)])
        n = size[index]
        ends = np.cumsum(n)
        ids = flat[np.repeat(begin[index] - ends + n, n) + np.arange(n.sum())]
        first = np.concatenate([[0], ends])[words.first]
        return Cut(ids, first, index, place, known, rare, raw)


    def base(self, words: W.Words, cut: "Cut") -> list[pa.Array]:
        """By text: words and end; words that are in the table; the sum of the logs
        of their smoothed counts; and the words that are not."""
        c = self.counts[cut.place] if len(self.hashes) else np.zeros(len(cut.known))
        held = cut.known[cut.index]
        logs = np.where(cut.known, np.log10(c + SMOOTH), 0.0)[cut.index]
        name = np.zeros(len(cut.known), dtype=np.int64)
        name[cut.rare] = np.arange(len(cut.rare))
        rest = pa.array(cut.raw, pa.binary()).cast(pa.string()).take(pa.array(name[cut.index[~held]]))
        return [
            pa.array(np.diff(words.first) + 1),
            pa.array(W.per_text(held, words.first)),
            pa.array(W.per_text(logs, words.first, np.float64)),
            columns.lists(rest, W.per_text(~held, words.first)),
        ]


@dataclass
class Cut:
    """Ids of some texts, those of text i at first[i] .. first[i + 1]; and for
    the distinct words their place in the table, whether they are in it, and the
    bytes of those that are not."""

    ids: np.ndarray
    first: np.ndarray
    index: np.ndarray
    place: np.ndarray
    known: np.ndarray
    rare: np.ndarray
    raw: list[bytes]


def _frequent(counted: DataFrame, most: int, tokenizer: str = TOKENIZER) -> tuple[Frequent, int]:
    """The words from the least count with which there are at most ``most``. Words
    without ids are cut here."""
    sizes = sorted(
        (r["c"], r["count"]) for r in counted.groupBy(F.least("c", F.lit(1 << 20)).alias("c")).count().collect()
    )
    least, held = (1 << 20) + 1, 0
    for c, n in reversed(sizes):
        if held + n > most:
            break
        least, held = c, held + n
    chosen = counted.where(F.col("c") >= least)
    if "ids" not in counted.columns:
        chosen = _with_pieces(chosen, tokenizer)
    table = chosen.select("hash", "c", "ids").toArrow().combine_chunks()
    hashes = table["hash"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    data, offsets = W.buffers(table["ids"].take(pa.array(order)))
    flat = data.view(np.int32) if len(data) else np.empty(0, dtype=np.int32)
    found = Frequent(hashes[order], table["c"].to_numpy()[order], offsets // 4, flat)
    return found, least


def _kind(size: int) -> type:
    """The least unsigned type that holds the ids of a vocabulary."""
    return np.uint16 if size <= 1 << 16 else np.uint32


def _running(docs: DataFrame, doc_id: str, text: str, frequent: Frequent, tokenizer: str) -> DataFrame:
    """(doc_id, h, ids, n_tokens, n_known, logs, rest): every text, whole, as the
    bytes of its ids, and a number by which it is dealt out; its words and end;
    how many words the table has, and the sum of the logs of their smoothed
    counts; and all other words."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    kind = _kind(pieces(tokenizer).size)
    names = ["doc_id", "h", "ids", "n_tokens", "n_known", "logs", "rest"]

    def run(batches):
        for batch in batches:
            for rows, data, offsets in W.units(batch, "text", AT_ONCE):
                words = W.split(data, offsets, W.SPACED_LOWER)
                cut = sent.value.cut(words, tokenizer)
                raw = cut.ids.astype(kind)
                packed = [raw[a:b].tobytes() for a, b in zip(cut.first[:-1].tolist(), cut.first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("h"), pa.array(packed, pa.binary()), *sent.value.base(words, cut)],
                    names=names,
                )

    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("h"), F.col(text).alias("text"))
    kinds = [T.BinaryType(), T.LongType(), T.LongType(), T.DoubleType(), T.ArrayType(T.StringType())]
    schema = keyed.select("doc_id", "h").schema
    for name, own in zip(names[2:], kinds, strict=True):
        schema.add(name, own)
    return W.bounded_batches(keyed).mapInArrow(run, schema)


def _ids(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the ids of some rows of ``_running`` from their bytes."""
    kind = np.dtype(_kind(size))
    return np.frombuffer(data.tobytes(), dtype=kind), offsets // kind.itemsize


def _marked(batch: pa.RecordBatch, end: int) -> list[np.ndarray]:
    """The texts of a batch of ``_running``, each begun by the end mark."""
    ids, first = _ids(*W.buffers(batch.column("ids")), end)
    ids, at = ids.astype(np.int32), first.tolist()
    mark = np.array([end], dtype=np.int32)
    return [np.concatenate([mark, ids[a:b]]) for a, b in zip(at[:-1], at[1:], strict=True)]


_BLOCK = "block int, values binary, n double, part int"


def _blocks(vector: np.ndarray, weight: float, part: int):
    """A part's vector as rows (block, values, n, part) of bounded size."""
    at = range(0, len(vector), BLOCK)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(range(len(at)), pa.int32()),
            pa.array([(vector[i : i + BLOCK] * weight).tobytes() for i in at], pa.binary()),
            pa.array([float(weight)] * len(at)),
            pa.array([part] * len(at), pa.int32()),
        ],
        names=["block", "values", "n", "part"],
    )


def _summed(parts: DataFrame, size: int) -> tuple[np.ndarray, float]:
    """(sum of vectors, sum of their weights) from rows of ``_blocks``, added in
    the order of the parts. What one task holds, and what reaches the driver, is
    the size of one vector."""

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for block, values, n, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(values)
                if block in held:
                    held[block][0] += values
                    held[block][1] += n
                else:
                    held[block] = [values.copy(), n]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.int32()),
                pa.array([x.tobytes() for x, _ in held.values()], pa.binary()),
                pa.array([n for _, n in held.values()], pa.float64()),
            ],
            names=["block", "values", "n"],
        )

    out, weight = np.zeros(size), 0.0
    ordered = parts.repartition("block").sortWithinPartitions("block", "part")
    with freed_shuffles(parts.sparkSession):
        rows = ordered.mapInArrow(run, "block int, values binary, n double").collect()
    for r in rows:
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["values"])
        weight = r["n"]
    return out, weight


def _company(running: DataFrame, ids: np.ndarray) -> np.ndarray:
    """Company counts of the frequent ids over all training texts."""
    shape = attention.company_of(ids, []).shape
    sent = running.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        total = np.zeros(shape)
        for batch in batches:
            texts = _marked(batch, len(ids) - 1)
            total += attention.company_of(sent.value, [np.append(t, len(ids) - 1) for t in texts])
        yield from _blocks(total.reshape(-1), 1.0, 0)  # whole numbers: their order does not matter

    rows = W.bounded_batches(running.select("ids")).mapInArrow(run, _BLOCK)
    return _summed(rows, shape[0] * shape[1])[0].reshape(shape)


def parts_of(tokens: int, least: int) -> int:
    """Into how many parts a corpus is dealt."""
    return max(1, int(tokens / (ROOM * least)))


def _fit(running: DataFrame, ids: np.ndarray, least: int) -> attention.Scorer:
    """The model fitted on all training texts, every token of which some part is
    to tell from those before it.

    The corpus is dealt by hashes of its rows to parts of somewhat over ``least`` tokens.
    A part's way leads over all its windows, shuffled, again and again until it has
    seen ``least`` tokens. It is taken in ``ROUNDS``: in each, every part goes on
    from the same weights, and the mean of the parts' weights begins the next. What
    a part sees, and in which order, depends on the rows alone, not on the files
    or tasks that they came in.
    """
    codes = attention.codes_from(ids, _company(running, ids))
    tokens, end = int(ids.sum()), int(codes.code[codes.end])
    if tokens < attention.WINDOW + 2:
        return attention.Scorer(codes, attention.blank_weights(codes))
    w, parts = attention.start_weights(codes), parts_of(tokens, least)
    shapes, cuts = {name: x.shape for name, x in w.items()}, np.cumsum([x.size for x in w.values()])
    dealt = running.withColumn("part", F.pmod("h", F.lit(parts)).cast("int")).select("part", "h", "ids")
    for turn in range(ROUNDS):
        sent = running.sparkSession.sparkContext.broadcast((codes, w))

        def run(batches, sent=sent, turn=turn):
            codes, start = sent.value
            code = codes.code.astype(np.uint16)  # a part is held whole

            def fitted(part, texts):
                """Blocks of the weights of one part."""
                stream = np.concatenate([*texts, code[-1:]])
                fitter = attention.Fitter(start, end, (13, part))
                passes = attention.passes_over(len(stream), least)
                fitter.walk(stream, attention.rate_after, passes, turn, ROUNDS)
                flat = np.concatenate([x.reshape(-1) for x in fitter.w.values()]).astype(np.float64)
                return _blocks(flat, float(len(stream)), part)

            held, now = [], None
            for batch in batches:
                for part, text in zip(batch.column("part").to_pylist(), _marked(batch, codes.end), strict=True):
                    if part != now:
                        if held:
                            yield from fitted(now, held)
                        held, now = [], part
                    held.append(code[text])
            if held:
                yield from fitted(now, held)

        own = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "h")
        total, n = _summed(W.bounded_batches(own).mapInArrow(run, _BLOCK), int(cuts[-1]))
        sent.unpersist()
        if n:
            flat = (total / n).astype(np.float32)
            w = {name: x.reshape(shapes[name]) for name, x in zip(shapes, np.split(flat, cuts[:-1]), strict=True)}
    return attention.Scorer(codes, w)


@dataclass
class Model:
    """The fitted scorer, and what the base score takes from all training texts:
    their tokens, different words and ends."""

    scorer: attention.Scorer
    total: int
    distinct: int
    ends: int

    @property
    def scale(self) -> float:
        return self.total + SMOOTH * (self.distinct + 1)


def learn(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    frequent: int = FREQUENT,
    least: int = attention.SEEN,
) -> tuple[Model, DataFrame, DataFrame]:
    """The model of the rows that are not held out, the table (word, c) of all
    their words, and all rows, held out or not, as ``_running`` has them, with a
    number ``row``. Texts are cut into ids once, for fitting and for scoring."""
    training = docs.where(~held_out(doc_id)).select(doc_id, text)
    sizes = training.agg(F.count("*").alias("n")).first()
    counted = store(count_words(training, text))
    sums = counted.agg(F.count("*").alias("n"), F.sum("c").alias("c")).first()
    table, _ = _frequent(counted, frequent, tokenizer)
    running = store(_running(docs, doc_id, text, table, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    fitted, size = running.where(~held_out("doc_id")).select("h", "ids"), pieces(tokenizer).size
    ids = np.append(_id_counts(fitted.select("ids"), size, _kind(size)), float(sizes["n"]))
    scorer = _fit(fitted, ids, least)
    total, distinct = (sums["c"] or 0) + sizes["n"], sums["n"] + int(sizes["n"] > 0)
    return Model(scorer, total, distinct, sizes["n"]), counted.select("word", "c"), running


def _scored(running: DataFrame, scorer: attention.Scorer) -> DataFrame:
    """(row, doc_id, n_tokens, n_known, logs, model): the model's log10
    probabilities of texts that are cut into ids."""
    sent = running.sparkSession.sparkContext.broadcast(scorer)
    names = ["row", "doc_id", "n_tokens", "n_known", "logs"]

    def run(batches):
        for batch in batches:
            for rows, data, offsets in W.units(batch, "ids"):
                logs = sent.value.score(*_ids(data, offsets, sent.value.codes.end)) / np.log(10)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(n) for n in names), pa.array(logs)], names=[*names, "model"]
                )

    return W.bounded_batches(running.select(*names, "ids")).mapInArrow(
        run, running.select(*names).schema.add("model", T.DoubleType())
    )


def score_texts(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    frequent: int = FREQUENT,
    least: int = attention.SEEN,
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities of the whole text).

    A token is a word, or the end of the text, which every text has: a null or
    empty text is its end alone. Rows that repeat a doc_id are scored each for
    itself. Without training rows all words are unknown and the model is uniform
    but for its random start; an empty table gives no rows.
    """
    model, counts, running = learn(docs, doc_id, text, tokenizer, frequent, least)
    each = running.select("row", F.explode("rest").alias("word"))
    c = F.coalesce(F.col("c"), F.lit(0))
    rest = (
        each.join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum((c > 0).cast("long")).alias("more_known"),
            F.sum(F.log10(c + F.lit(SMOOTH))).alias("more_logs"),
        )
    )
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) + F.lit(float(np.log10(model.ends + SMOOTH)))
    return (
        _scored(running, model.scorer)
        .join(rest, "row", "left")
        .select(
            F.col("doc_id").alias(doc_id),
            held_out("doc_id").alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + F.lit(int(model.ends > 0))).alias("n_known"),
            F.lit(model.total).cast("long").alias("train_tokens"),
            (logs - F.col("n_tokens") * F.lit(float(np.log10(model.scale)))).alias("base_score"),
            F.col("model").alias("score"),
        )
    )
