"""Repeated passages, found in a compacted De Bruijn graph of word windows.

Every window of consecutive words is an edge of the graph, from its first words
to its last. A window is dealt out by its minimizer: the least hash among the
short runs of words inside it. Neighbouring windows of a document mostly share
the minimizer, and together they make one path segment. Equal windows have equal
minimizers, so a window can only recur in a segment of the same minimizer.

* A minimizer that occurs once has no repeated window: its segment is dropped.
* Equal segments are a repeated path without branches. It is compacted to one
  row with a count, and all its windows are repeated.
* Where different segments share a minimizer, the graph branches. Only there
  are single windows made, once for each different segment, and counted.

The verdicts (a bit per window of a segment) are joined back to the source
coordinates of every occurrence, and words are removed by those coordinates.
What is shuffled is one narrow row per segment, about one for every thirteen
words, and the texts themselves where single windows or the results are made.
Rolling hashes choose the minimizers only. Whether segments and windows are equal
is decided by their bytes: read at their source coordinates, 128 bits of XXH3 each.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm import words as W
from citeline.llm.columns import add_struct, fresh
from citeline.llm.tables import store

#: Consecutive words of a window.
WINDOW = 35
#: Words of the runs among which the minimizer of a window is chosen.
ANCHOR = 10



def _least(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each ``width`` consecutive hashes, the first of equals."""
    at = np.arange(len(hashes))
    have = 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(hashes[left] <= hashes[right], left, right)
        have += step
    return at


def _segments(words: W.Words, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, first window by text, windows, minimizer, first window, minimizer's
    place in the segment) of the segments."""
    runs = W.rolling(words.hash, anchor)
    starts = np.flatnonzero(W.inside_one(words, window))
    if not len(starts):
        return (np.empty(0, dtype=np.int64),) * 6
    least = _least(runs, window - anchor + 1)[starts]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (np.diff(starts) != 1) | (np.diff(least) != 0)
    head = np.flatnonzero(fresh)
    size = np.diff(np.append(head, len(starts)))
    first, least = starts[head], least[head]
    owner = words.owner()[first]
    return owner, first - words.first[owner], size, runs[least], first, least - first


def _digests(words: W.Words, first: np.ndarray, last: np.ndarray, seed: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Two numbers for the bytes of the words first .. last, joined by one space."""
    joined, start, end = words.joined()
    digests = [
        xxhash.xxh3_128_digest(joined[i:j], k)
        for i, j, k in zip(start[first].tolist(), end[last].tolist(), seed.tolist(), strict=True)
    ]
    both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _keys(doc_id: str, text: str) -> list[Column]:
    """Two numbers that stand for a row: rows with the same pair are copies."""
    return [
        F.xxhash64(F.col(doc_id)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k2"),
    ]


def _segment_rows(docs: DataFrame, doc_id: str, text: str, window: int, anchor: int) -> DataFrame:
    """(k1, k2, at, n, anchor, path, path2): the path segments of all documents."""
    keyed = docs.select(*_keys(doc_id, text), F.col(text).alias("text"))

    def cut(batches):
        for batch in batches:
            for rows, data, offsets in W.units(batch, "text"):
                words = W.split(data, offsets, W.SPACED)
                owner, at, n, least, first, place = _segments(words, window, anchor)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("k1").take(pa.array(owner)),
                        rows.column("k2").take(pa.array(owner)),
                        pa.array(at.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(least.astype(np.uint64).view(np.int64)),
                        *_digests(words, first, first + n + window - 2, place),
                    ],
                    names=["k1", "k2", "at", "n", "anchor", "path", "path2"],
                )

    schema = "k1 bigint, k2 bigint, at int, n int, anchor bigint, path bigint, path2 bigint"
    return W.bounded_batches(keyed).mapInArrow(cut, schema)


def _windows(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame, window: int) -> DataFrame:
    """(anchor, path, path2, i, edge, edge2, c): the single windows of the segments
    of ``wanted`` (k1, k2, at, n, anchor, path, path2, c), read from their documents."""
    listed = store(
        wanted.groupBy("k1", "k2").agg(
            F.collect_list(F.struct("at", "n", "anchor", "path", "path2", "c")).alias("segments")
        )
    )
    texts = docs.select(*_keys(doc_id, text), F.col(text).alias("text"))
    source = listed.join(texts, ["k1", "k2"]).select("text", "segments")

    def cut(batches):
        for batch in batches:
            for rows, data, offsets in W.units(batch, "text"):
                words = W.split(data, offsets, W.SPACED)
                column = rows.column("segments")
                flat = column.flatten()
                size = np.diff(column.offsets.to_numpy())
                at, n, anchor, path, path2, c = (
                    flat.field(name).to_numpy(zero_copy_only=False) for name in ("at", "n", "anchor", "path", "path2", "c")
                )
                first = np.repeat(words.first[:-1], size) + at
                i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                edge = np.repeat(first, n) + i
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(anchor, n)),
                        pa.array(np.repeat(path, n)),
                        pa.array(np.repeat(path2, n)),
                        pa.array(i.astype(np.int32)),
                        *_digests(words, edge, edge + window - 1, np.zeros(len(edge), dtype=np.int64)),
                        pa.array(np.repeat(c, n)),
                    ],
                    names=["anchor", "path", "path2", "i", "edge", "edge2", "c"],
                )

    return W.bounded_batches(source).mapInArrow(
        cut, "anchor bigint, path bigint, path2 bigint, i int, edge bigint, edge2 bigint, c bigint"
    )


def repeated_windows(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
) -> DataFrame:
    """(k1, k2, spans): for each text with repeated windows, structs of a first
    window and a mask whose bit i marks the window i words further on."""
    rows = store(_segment_rows(docs, doc_id, text, window, anchor))
    anchors = store(
        rows.groupBy("anchor")
        .agg(
            F.count("*").alias("c"),
            ((F.min("path") != F.max("path")) | (F.min("path2") != F.max("path2"))).alias("branches"),
        )
        .where(F.col("c") > 1)
        .select("anchor", "branches")
    )
    rows = store(rows.join(anchors, "anchor"))
    # All rows of a path hold the same words, so any of them may stand for it.
    paths = store(
        rows.groupBy("anchor", "path", "path2").agg(
            F.count("*").alias("c"),
            *[F.first(x).alias(x) for x in ("k1", "k2", "at", "n", "branches")],
        )
    )
    whole = paths.where(F.col("c") > 1).select(
        "anchor", "path", "path2", (F.expr("shiftleft(1L, n)") - 1).alias("mask")
    )
    single = store(_windows(docs, doc_id, text, paths.where("branches"), window))
    again = store(
        single.groupBy("anchor", "edge", "edge2").agg(F.sum("c").alias("t")).where("t > 1").drop("t")
    )
    partly = single.join(again, ["anchor", "edge", "edge2"]).groupBy("anchor", "path", "path2").agg(
        F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask")
    )
    verdicts = store(
        whole.union(partly).groupBy("anchor", "path", "path2").agg(F.bit_or("mask").alias("mask"))
    )
    found = rows.join(verdicts, ["anchor", "path", "path2"])
    return found.groupBy("k1", "k2").agg(F.collect_set(F.struct("at", "mask")).alias("spans"))


def _strip(window: int):
    def compute(data: np.ndarray, offsets: np.ndarray, spans: pa.Array) -> pa.Array:
        words = W.split(data, offsets, W.SPACED)
        joined, start, end = words.joined()
        spans = spans.fill_null([]) if spans.null_count else spans
        flat = spans.flatten()
        size = np.diff(spans.offsets.to_numpy())
        at, mask = (flat.field(name).to_numpy(zero_copy_only=False) for name in ("at", "mask"))
        first = np.repeat(words.first[:-1], size) + at
        bits = [first[(mask >> i) & 1 == 1] + i for i in range(window)]
        gone = W.covered(len(words), np.concatenate(bits) if len(first) else first, window)
        removed = W.per_text(gone, words.first)
        kept = []
        for i in range(len(offsets) - 1):
            a, b = words.first[i], words.first[i + 1]
            if a == b:
                kept.append(b"")
            elif not removed[i]:
                kept.append(joined[start[a] : end[b - 1]])
            else:
                edge = np.flatnonzero(np.diff(gone[a:b], prepend=True, append=True)) + a
                kept.append(b" ".join(joined[start[x] : end[y - 1]] for x, y in edge.reshape(-1, 2)))
        return pa.StructArray.from_arrays(
            [pa.array(np.diff(words.first)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())],
            names=["n_words", "n_removed", "kept"],
        )

    return compute


def strip_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    anchor: int = ANCHOR,
    into: str = "passages",
) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_removed, kept (the words left,
    joined by one space).

    A word goes if a window that covers it also begins anywhere else, the same
    document included; windows are judged on the input. A null text has no
    words; a text shorter than a window keeps all. Rows that are equal in doc_id
    and text repeat each other like any two documents. A column called ``into``
    is replaced, others pass through. Empty tables give no rows.
    """
    if not anchor <= window < anchor + 63:
        raise ValueError("a segment has at most 63 windows: the mask of one is a number")
    spans = store(repeated_windows(docs, doc_id, text, window, anchor))
    k1, k2, mark = fresh(docs, "__k1"), fresh(docs, "__k2"), fresh(docs, "__spans")
    one, two = _keys(doc_id, text)
    keyed = docs.withColumns({k1: one, k2: two})
    joined = keyed.join(
        spans.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(mark)), [k1, k2], "left"
    ).select(*[F.col(f"`{n}`") for n in docs.columns if n != into], mark)
    return add_struct(
        joined, text, into, "struct<n_words:bigint,n_removed:bigint,kept:string>", lambda: _strip(window), mark
    )


def digest(stripped: DataFrame, doc_id: str = "doc_id", into: str = "passages") -> DataFrame:
    """One row per document: counts and a hash of the words left."""
    return stripped.select(
        doc_id,
        F.col(f"`{into}`.n_words").alias("n_words"),
        F.col(f"`{into}`.n_removed").alias("n_removed"),
        F.sha2(F.col(f"`{into}`.kept"), 256).alias("kept_sha256"),
    )
