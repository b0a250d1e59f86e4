"""Benchmark decontamination by Wu-Manber search over words.

Words stand where the published algorithm has characters. Test windows of one
length share a table of shifts by blocks of two words: a block that no window
holds lets the search jump over every position it rules out. Where the shift is
zero, the hash of the block selects the windows that end in it, and their bytes
are compared with the text.

The test items are the stated query set: they are taken in blocks of a bounded
size, and every document is searched for each block before the next is made.
"""

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm import words as W
from citeline.llm.columns import add_struct, fresh, lists
from citeline.llm.tables import store

#: Consecutive words of an item that make a window.
WINDOW = 10
#: Bytes of item text whose tables are sent to every worker at a time.
BLOCK_BYTES = 2 << 20
#: Bytes of an item above which it is cut into overlapping pieces.
PIECE_BYTES = 1 << 18
#: Word positions that one cursor of the vectorised search walks.
STRETCH = 256

_PAIR = np.uint64(0xC2B2AE3D27D4EB4F)
RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"


class Table:
    """Shift table and suffix buckets for windows of one length."""

    def __init__(self, length: int, hashes: np.ndarray, ids: np.ndarray):
        """hashes: a row of word hashes per window; ids: their window numbers."""
        self.length, self.block = length, min(2, length)
        blocks = self.blocks(hashes[:, :-1], hashes[:, 1:]) if self.block == 2 else hashes
        bits = min(22, max(10, math.ceil(math.log2(blocks.size * 8))))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - self.block + 1, dtype=np.int32)
        for j in range(blocks.shape[1]):  # later blocks allow shorter jumps
            self.shift[blocks[:, j] >> self.down] = blocks.shape[1] - 1 - j
        order = np.argsort(blocks[:, -1], kind="stable")
        self.suffix, self.ids, self.head = blocks[order, -1], ids[order], hashes[order, 0]

    @staticmethod
    def blocks(before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return W.mix(before * _PAIR + last)

    def search(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window number) where a window may occur."""
        at = np.arange(self.length - 1, len(hashes), STRETCH)
        stop = np.minimum(at + STRETCH, len(hashes))
        ends, keys = [], []
        while len(at):
            key = self.blocks(hashes[at - 1], hashes[at]) if self.block == 2 else hashes[at]
            jump = self.shift[key >> self.down]
            stay = jump == 0
            if stay.any():
                ends.append(at[stay])
                keys.append(key[stay])
            at = at + np.maximum(jump, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not ends:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        start, keys = np.concatenate(ends) - (self.length - 1), np.concatenate(keys)
        low = np.searchsorted(self.suffix, keys, side="left")
        size = np.searchsorted(self.suffix, keys, side="right") - low
        start, entry = np.repeat(start, size), np.repeat(low - np.cumsum(size) + size, size)
        entry = entry + np.arange(len(entry))
        same = self.head[entry] == hashes[start]
        return start[same], self.ids[entry[same]]


class Patterns:
    """The windows of some items, ready to be searched for."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        held: dict[bytes, set[int]] = {}
        found: dict[int, list[np.ndarray]] = {}
        numbers: dict[int, list[int]] = {}
        for name, text in items:
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            own = W.split(data, np.array([0, len(data)]), W.LETTERS_LOWER)
            joined, start, end = own.joined()
            length = min(window, len(own))
            for i in range(len(own) - length + 1) if length else ():
                key = joined[start[i] : end[i + length - 1]]
                if key not in held:
                    found.setdefault(length, []).append(own.hash[i : i + length])
                    numbers.setdefault(length, []).append(len(held))
                    held[key] = set()
                held[key].add(number[name])
        self.texts = list(held)
        owners = [sorted(x) for x in held.values()]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in owners])]).astype(np.int64)
        self.owners = np.array([i for x in owners for i in x], dtype=np.int64)
        self.tables = [
            Table(length, np.array(rows), np.array(numbers[length]))
            for length, rows in sorted(found.items())
        ]

    def occurrences(self, words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, window number) of every occurrence."""
        joined, begin, end = words.joined()
        found = []
        for table in self.tables:
            n = table.length
            start, ids = table.search(words.hash)
            whole = W.inside_one(words, n)[start]
            start, ids = start[whole], ids[whole]
            equal = [
                joined[a:b] == self.texts[i]
                for a, b, i in zip(
                    begin[start].tolist(), end[start + n - 1].tolist(), ids.tolist(), strict=True
                )
            ]
            equal = np.array(equal, dtype=bool)
            found.append((start[equal], np.full(equal.sum(), n), ids[equal]))
        if not found:
            return (np.empty(0, dtype=np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        words = W.split(data, offsets, W.LETTERS_LOWER)
        start, length, ids = self.occurrences(words)
        hit = W.covered(len(words), start, length)
        owner = words.owner()
        size = self.first[ids + 1] - self.first[ids]
        entry = np.repeat(self.first[ids] - np.cumsum(size) + size, size)
        item = self.owners[entry + np.arange(len(entry))]
        pair = np.unique(np.repeat(owner[start], size) * max(1, len(self.names)) + item)
        texts = len(offsets) - 1
        names = pa.array(self.names, pa.string()).take(pa.array(pair % max(1, len(self.names))))
        opens, closes = self._runs(hit, words.first)
        base = words.first[owner[opens]]
        spans = pa.StructArray.from_arrays(
            [pa.array(opens - base), pa.array(closes - base)], names=["start", "end"]
        )
        return pa.StructArray.from_arrays(
            [
                pa.array(np.diff(words.first)),
                pa.array(W.per_text(hit, words.first)),
                lists(names, np.bincount(pair // max(1, len(self.names)), minlength=texts)),
                lists(spans, np.bincount(owner[opens], minlength=texts)),
            ],
            names=["n_words", "n_hit", "items", "spans"],
        )

    @staticmethod
    def _runs(hit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and ends of the runs of hit words, cut between texts."""
        begins = hit.copy()
        begins[1:] &= ~hit[:-1]
        fresh = first[first < len(hit)]
        begins[fresh] = hit[fresh]
        stops = np.union1d(np.flatnonzero(~hit), first)
        opens = np.flatnonzero(begins)
        return opens, stops[np.searchsorted(stops, opens, side="right")]


def _pieces(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, piece): long items cut so that each window lies in one piece."""

    def cut(batches):
        for batch in batches:
            names, out = batch.column(0).to_pylist(), ([], [])
            for i, value in enumerate(batch.column(1).to_pylist()):
                data = np.frombuffer((value or "").encode(), dtype=np.uint8)
                joined, start, end = W.split(data, np.array([0, len(data)]), W.LETTERS_LOWER).joined()
                a = 0
                while a < len(start):
                    b = int(np.searchsorted(end, start[a] + PIECE_BYTES, side="right"))
                    b = min(len(start), max(b, a + window))
                    out[0].append(names[i])
                    out[1].append(joined[start[a] : end[b - 1]].decode())
                    a = b if b == len(start) else b - window + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["item", "piece"]
            )

    named = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(text).alias("piece")
    )
    return W.bounded_batches(named).mapInArrow(cut, "item string, piece string")


class Blocks:
    """Search tables for all items, made one block after the other: the driver
    holds the block that is asked for and no other."""

    def __init__(self, pieces: DataFrame, count: int, window: int):
        self.pieces, self.count, self.window = pieces, count, window

    def __len__(self) -> int:
        return self.count

    def __iter__(self):
        block = F.pmod(F.xxhash64("item", "piece"), F.lit(self.count))
        for i in range(self.count):
            yield Patterns([tuple(r) for r in self.pieces.where(block == i).collect()], self.window)


def item_blocks(items: DataFrame, item_id: str, text: str, window: int = WINDOW) -> Blocks:
    """Search tables for all items, in blocks of about ``BLOCK_BYTES`` of text.

    The items are cut into pieces once. The number of blocks follows from the
    measured size, so what the driver holds and sends at a time is bounded
    whatever the size of the item table.
    """
    pieces = store(_pieces(items, item_id, text, window).distinct())
    size = pieces.agg(F.sum(F.octet_length("piece")).alias("n")).first()["n"] or 0
    return Blocks(pieces, max(1, math.ceil(2 * size / BLOCK_BYTES)) if size > BLOCK_BYTES else 1, window)


def search_items(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    into: str = "benchmark_hits",
) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, n_hit (words inside an
    occurrence of an item's window), items (ids found, as sorted strings) and
    spans (hit runs as word positions, end exclusive).

    A null or empty text has no words and no hits; an item without words is
    never found; an item id that is null reads "null"; repeated rows each get
    their result; an empty table of either kind gives no hits. A column of
    ``docs`` called ``into`` is replaced, others pass through.
    """
    context = docs.sparkSession.sparkContext
    blocks = item_blocks(items, item_id, item_text, window)
    if len(blocks) == 1:
        sent = context.broadcast(next(iter(blocks)))
        return add_struct(docs, text, into, RESULT, lambda: sent.value)
    row = fresh(docs, "__row")
    rows = whole = None
    parts = []
    for patterns in blocks:
        sent = context.broadcast(patterns)
        del patterns  # before the next is made
        if whole is None:  # has a row for every document, the others for those with hits
            rows = store(docs.withColumn(row, F.monotonically_increasing_id()))
            whole = store(add_struct(rows, text, into, RESULT, lambda sent=sent: sent.value))
        else:
            found = add_struct(rows.select(row, text), text, "__hits", RESULT, lambda sent=sent: sent.value)
            parts.append(store(found.where(F.col("__hits.n_hit") > 0).select(row, "__hits")))
        sent.unpersist()
    more = reduce(DataFrame.unionAll, parts).groupBy(row).agg(F.collect_list("__hits").alias("__more"))
    return _merged(whole.join(store(more), row, "left"), into).drop(row, "__more").select(
        *[F.col(f"`{c}`") for c in [*docs.drop(into).columns, into]]
    )


def _merged(df: DataFrame, into: str) -> DataFrame:
    """One struct from that of the first block of items and those of others, in
    the array ``__more``: spans are united."""
    every = F.concat(F.array(F.col(f"`{into}`")), F.coalesce("__more", F.array().cast(f"array<{RESULT}>")))
    spans = F.array_sort(F.flatten(F.transform(every, lambda x: x["spans"])))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    united = F.aggregate(
        spans,
        none,
        lambda held, s: F.when(
            F.try_element_at(held, F.lit(-1))["end"] >= s["start"],
            F.concat(
                F.slice(held, 1, F.size(held) - 1),
                F.array(
                    F.struct(
                        F.try_element_at(held, F.lit(-1))["start"].alias("start"),
                        F.greatest(F.try_element_at(held, F.lit(-1))["end"], s["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(held, F.array(s))),
    )
    out = df.withColumn("__united", united)
    length = F.aggregate("__united", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(every, lambda x: x["items"]))))
    merged = F.struct(
        F.col(f"`{into}`.n_words").alias("n_words"),
        length.alias("n_hit"),
        items.alias("items"),
        F.col("__united").alias("spans"),
    )
    return out.withColumn(into, merged).drop("__united")


def digest(found: DataFrame, doc_id: str = "doc_id", into: str = "benchmark_hits") -> DataFrame:
    """One row per document: counts and a hash of the sorted item ids."""
    hits = F.col(f"`{into}`")
    return found.select(
        doc_id,
        hits["n_words"].alias("n_words"),
        hits["n_hit"].alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", hits["items"]), 256).alias("items_sha256"),
        (hits["n_hit"] > 0).alias("contaminated"),
    )
