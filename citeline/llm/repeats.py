"""Repeated byte strings, by common-prefix intervals of a sparse suffix array.

Every string of ``length`` bytes holds an anchor: the least hash among the runs
of ``ANCHOR`` bytes inside it. Equal strings have equal anchors at equal places,
so the suffix array needs the positions of anchors alone, about one in 170, and
only those whose anchor occurs again. Neighbouring strings of a text mostly share
the anchor; together they are one segment.

* A segment whose anchor occurs nowhere else is dropped.
* Equal segments are one row with a count, and all their strings are repeated.
* Segments that share an anchor and differ make a bucket of the suffix array:
  sorted by the text from the anchor on, scanned with a stack, and tested for
  what stands to the left (``intervals.maximal_repeats``). Each maximal repeat
  comes with all its members, and is compared byte by byte.

A bucket of more than ``BUCKET`` different segments (a passage that is in a third
of all texts) is parted by longer prefixes, as a suffix array is sorted by
buckets: its strings are dealt to blocks by the place of the anchor in them, and
to buckets by the bytes that all strings of a block have in common. In the end a
bucket is small, or is one string. No group is ever gathered that is larger.

What is repeated is joined back to all occurrences of the segments. Segments are
told apart by 128 bits of XXH3.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm import words as W
from citeline.llm.columns import add_struct, fresh
from citeline.llm.intervals import maximal_repeats
from citeline.llm.tables import store

#: Bytes of a repeated string at least, and of an anchor.
LENGTH, ANCHOR = 400, 64
#: Different segments of a bucket that one task scans, at most.
BUCKET = 1000
#: Blocks that the strings of a larger bucket are dealt to.
FAN = 8
_POSITIONS = 1 << 22
_BITS = np.uint64(28)

_SEGMENT = "k1 bigint, k2 bigint, at bigint, lo int, hi int, anchor bigint, p1 bigint, p2 bigint"


def _run_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k bytes (a power of two)."""
    h = W.mix(data.astype(np.uint64) + np.uint64(1))
    have = 1
    if k >= 8:  # eight bytes at a time
        h = W.mix(np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,)).astype(np.uint64))
        have = 8
    while have < k:
        h = h[:-have] * np.uint64(0xD6E8FEB86659FD93) + h[have:]
        have *= 2
    return W.mix(h)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(after[:n], ahead[width - 1 : width - 1 + n])


def _segments(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """(text, anchor's position, least and greatest bytes before it in a string,
    anchor's hash) of the segments of some texts, in parts of bounded size."""
    data = np.ascontiguousarray(data)
    width = length - anchor + 1
    for a in range(0, len(data) - length + 1, _POSITIONS):
        stop = min(len(data), a + _POSITIONS + length - 1)
        hashes = _run_hashes(data[a:stop], anchor)
        keyed = (hashes >> _BITS << _BITS) | np.arange(len(hashes), dtype=np.uint64)  # the first of equals
        least = (_least(keyed, width) & ((np.uint64(1) << _BITS) - np.uint64(1))).astype(np.int64)
        start = np.arange(a, a + len(least))
        owner = np.searchsorted(offsets, start, side="right") - 1
        good = start + length <= offsets[np.minimum(owner + 1, len(offsets) - 1)]
        start, owner, least = start[good], owner[good], least[good] + a
        if not len(start):
            continue
        head = np.ones(len(start), dtype=bool)
        head[1:] = (np.diff(start) != 1) | (np.diff(least) != 0)
        first = np.flatnonzero(head)
        last = np.append(first[1:], len(start)) - 1
        at = least[first]
        yield owner[first], at, at - start[last], at - start[first], hashes[at - a]


def _keys(doc_id: str, text: str) -> list[Column]:
    """Two numbers that stand for a row: rows with the same pair are copies."""
    return [
        F.xxhash64(F.col(doc_id)).alias("k1"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("k2"),
    ]


def _signed(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    return pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())


def _segment_rows(docs: DataFrame, doc_id: str, text: str, length: int, anchor: int) -> DataFrame:
    keyed = docs.select(*_keys(doc_id, text), F.col(text).alias("text"))

    def cut(batches):
        for batch in batches:
            for rows, data, offsets in W.units(batch, "text"):
                raw = data.tobytes()
                for owner, at, lo, hi, hashes in _segments(data, offsets, length, anchor):
                    names = [
                        xxhash.xxh3_128_digest(raw[i:j], seed)
                        for i, j, seed in zip((at - hi).tolist(), (at - lo + length).tolist(), hi.tolist(), strict=True)
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.column("k1").take(pa.array(owner)),
                            rows.column("k2").take(pa.array(owner)),
                            pa.array(at - offsets[owner]),
                            pa.array(lo.astype(np.int32)),
                            pa.array(hi.astype(np.int32)),
                            pa.array(hashes.view(np.int64)),
                            *_signed(names),
                        ],
                        names=["k1", "k2", "at", "lo", "hi", "anchor", "p1", "p2"],
                    )

    return W.bounded_batches(keyed).mapInArrow(cut, _SEGMENT)


_MEMBER = ["k1", "k2", "at", "lo", "hi", "anchor", "p1", "p2", "b1", "b2"]


def _beside_texts(docs: DataFrame, doc_id: str, text: str, members: DataFrame, more: list[str]) -> DataFrame:
    """(text, members): the texts that members stand in, with the lists of them."""
    columns = [c for c in [*_MEMBER, *more] if c not in ("k1", "k2")]
    listed = store(members.groupBy("k1", "k2").agg(F.collect_list(F.struct(*columns)).alias("members")))
    one, two = _keys(doc_id, text)
    # copies of a row hold the same members: one of them will do
    texts = docs.select(one, two, F.col(text).alias("text")).join(listed.select("k1", "k2"), ["k1", "k2"], "left_semi")
    texts = texts.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    return listed.join(texts, ["k1", "k2"]).select("k1", "k2", "text", "members")


def _each_member(batch: pa.RecordBatch):
    """(flat members, row of each, bytes of all texts, begin of each member's text)."""
    data, offsets = W.buffers(batch.column("text"))
    column = batch.column("members")
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return column.flatten(), row, data.tobytes(), offsets[row]


def _finer(docs: DataFrame, doc_id: str, text: str, members: DataFrame, length: int, width: int) -> DataFrame:
    """Members of buckets that are too large, dealt to blocks of ``width`` places
    of the anchor, and to buckets by what all strings of a block have in common."""
    source = _beside_texts(docs, doc_id, text, members, [])

    def deal(batches):
        for batch in batches:
            flat, row, raw, begin = _each_member(batch)
            lo, hi, at = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("lo", "hi", "at"))
            low, count = lo // width, hi // width - lo // width + 1
            own = np.repeat(np.arange(len(lo)), count)
            block = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + low[own]
            x, y = block * width, (block + 1) * width - 1  # the block's least and greatest place
            place = begin[own] + at[own]
            held = flat.field("anchor").to_numpy(zero_copy_only=False)[own].tolist()
            names = [
                xxhash.xxh3_128_digest(raw[i:j] + b"%d,%d,%d" % (a, b, w), width)
                for i, j, a, b, w in zip(
                    (place - x).tolist(), np.maximum(place - x, place + length - y).tolist(), held, x.tolist(), y.tolist(), strict=True
                )
            ]
            take = pa.array(own)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k1").take(pa.array(row[own])),
                    batch.column("k2").take(pa.array(row[own])),
                    pa.array(at[own]),
                    pa.array(np.maximum(lo[own], x).astype(np.int32)),
                    pa.array(np.minimum(hi[own], y).astype(np.int32)),
                    *(flat.field(n).take(take) for n in ("anchor", "p1", "p2")),
                    *_signed(names),
                ],
                names=_MEMBER,
            )

    return W.bounded_batches(source).mapInArrow(deal, _SEGMENT + ", b1 bigint, b2 bigint")


def _contexts(docs: DataFrame, doc_id: str, text: str, members: DataFrame, length: int) -> DataFrame:
    """(b1, b2, anchor, p1, p2, lo, hi, left, right): members with the bytes
    before and from the anchor on that their strings reach."""
    source = _beside_texts(docs, doc_id, text, members, [])

    def read(batches):
        for batch in batches:
            flat, _, raw, begin = _each_member(batch)
            lo, hi, at = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("lo", "hi", "at"))
            place = begin + at
            yield pa.RecordBatch.from_arrays(
                [
                    *(flat.field(n) for n in ("b1", "b2", "anchor", "p1", "p2", "lo", "hi")),
                    pa.array([raw[i:j] for i, j in zip((place - hi).tolist(), place.tolist(), strict=True)], pa.binary()),
                    pa.array([raw[i:j] for i, j in zip(place.tolist(), (place + length - lo).tolist(), strict=True)], pa.binary()),
                ],
                names=["b1", "b2", "anchor", "p1", "p2", "lo", "hi", "left", "right"],
            )

    return W.bounded_batches(source).mapInArrow(
        read, "b1 bigint, b2 bigint, anchor bigint, p1 bigint, p2 bigint, lo int, hi int, left binary, right binary"
    )


_REPEAT = "anchor bigint, p1 bigint, p2 bigint, lo int, hi int, g1 bigint, g2 bigint"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def _scanned(rows: list[dict], length: int, groups: bool):
    """Rows of ``_REPEAT`` for one bucket, sorted by the text from the anchor on."""
    found: list[list[tuple]] = [[] for _ in rows]
    for left, right, members in maximal_repeats([r["left"] for r in rows], [r["right"] for r in rows], length):
        name = None
        for i in members:
            r = rows[i]
            lo, hi = max(r["lo"], length - right), min(r["hi"], left)
            if lo <= hi:
                if groups and name is None:
                    name = np.frombuffer(xxhash.xxh3_128_digest(r["left"][len(r["left"]) - left :] + r["right"][:right]), dtype=np.int64).tolist()
                found[i].append((lo, hi, *(name or (0, 0))))
    for r, own in zip(rows, found, strict=True):
        spans = own if groups else [(a, b, 0, 0) for a, b in _merged([x[:2] for x in own])]
        for lo, hi, g1, g2 in spans:
            yield r["anchor"], r["p1"], r["p2"], lo, hi, g1, g2


def _scan(contexts: DataFrame, length: int, groups: bool) -> DataFrame:
    """The repeats of every bucket: buckets lie together and sorted, and one of
    them is held at a time."""
    ordered = contexts.repartition("b1", "b2").sortWithinPartitions("b1", "b2", "right", "left")
    names = [x.split()[0] for x in _REPEAT.split(", ")]

    def packed(found):
        columns = list(zip(*found, strict=True)) if found else [()] * len(names)
        kinds = [pa.int64()] * 3 + [pa.int32()] * 2 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def run(batches):
        held, key = [], None
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if (r["b1"], r["b2"]) != key:
                    if len(held) > 1:
                        found.extend(_scanned(held, length, groups))
                    held, key = [], (r["b1"], r["b2"])
                held.append(r)
            yield packed(found)
        if len(held) > 1:
            yield packed(list(_scanned(held, length, groups)))

    return W.bounded_batches(ordered).mapInArrow(run, _REPEAT)


def _buckets(members: DataFrame, bucket: int) -> DataFrame:
    """Members of buckets of several segments, with ``large``: whether they are
    more than one task is to scan."""
    sizes = store(
        members.groupBy("b1", "b2").agg(F.count("*").alias("m")).where("m > 1").select("b1", "b2", (F.col("m") > bucket).alias("large"))
    )
    return members.join(sizes, ["b1", "b2"])


def _repeats(
    docs: DataFrame, doc_id: str, text: str, length: int, anchor: int, bucket: int, groups: bool
) -> tuple[DataFrame, DataFrame]:
    """(segments, repeats): the segments of all texts whose anchor occurs again,
    and by (anchor, p1, p2) the places lo .. hi of the anchor in repeated strings."""
    if length <= anchor or anchor & (anchor - 1):
        raise ValueError("an anchor is a power of two of bytes, fewer than a string")
    rows = store(_segment_rows(docs, doc_id, text, length, anchor))
    again = store(rows.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    rows = store(rows.join(again, "anchor"))
    paths = store(
        rows.groupBy("anchor", "p1", "p2").agg(
            F.count("*").alias("c"), F.min(F.struct("k1", "k2", "at", "lo", "hi")).alias("one")
        ).select("anchor", "p1", "p2", "c", "one.*")
    )
    none = F.lit(0).cast("long")
    repeats = paths.where("c > 1").select(
        "anchor", "p1", "p2", "lo", "hi", (F.col("p1") if groups else none).alias("g1"), (F.col("p2") if groups else none).alias("g2")
    )
    members = store(_buckets(paths.withColumns({"b1": F.col("anchor"), "b2": F.lit(0).cast("long")}).select(*_MEMBER), bucket))
    small, width = members.where(~F.col("large")).select(*_MEMBER), length - anchor + 1
    while not (large := members.where("large")).isEmpty():
        if width == 1:  # all members of a bucket are the same string
            names = (F.col("b1"), F.col("b2")) if groups else (none, none)
            same = large.select("anchor", "p1", "p2", "lo", "hi", names[0].alias("g1"), names[1].alias("g2"))
            repeats = repeats.union(same)
            break
        width = -(-width // FAN)
        dealt = store(_finer(docs, doc_id, text, large.select(*_MEMBER), length, width))
        members = store(_buckets(dealt, bucket))
        small = small.union(members.where(~F.col("large")).select(*_MEMBER))
    scanned = store(_scan(_contexts(docs, doc_id, text, store(small), length), length, groups))
    return rows, repeats.union(scanned)


def repeat_groups(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    bucket: int = BUCKET,
) -> DataFrame:
    """(g1, g2, doc_id, start, length): the maximal repeats of ``length`` bytes or
    more around each anchor, and every occurrence of each, in bytes of the text.

    Two numbers name the repeated string. A string that recurs beyond the reach
    of one anchor (its strings of ``length`` bytes) comes as overlapping groups,
    one per anchor. A string repeated in equal segments has one row for each row
    of ``docs``; null and short texts have none, an empty table gives no rows.
    """
    rows, repeats = _repeats(docs, doc_id, text, length, anchor, bucket, True)
    one, two = _keys(doc_id, text)
    names = docs.select(one, two, F.col(doc_id).alias("doc_id")).distinct()
    found = rows.drop("lo", "hi").join(repeats, ["anchor", "p1", "p2"]).join(names, ["k1", "k2"])
    return found.select(
        "g1", "g2", F.col("doc_id").alias(doc_id), (F.col("at") - F.col("hi")).alias("start"), (F.col("hi") - F.col("lo") + length).cast("long").alias("length")
    ).distinct()


def repeated_spans(
    docs: DataFrame, doc_id: str, text: str, length: int = LENGTH, anchor: int = ANCHOR, bucket: int = BUCKET
) -> DataFrame:
    """(k1, k2, spans): for each text with repeated strings, the bytes they cover,
    as structs of start and end that may overlap."""
    rows, repeats = _repeats(docs, doc_id, text, length, anchor, bucket, False)
    verdicts = store(repeats.groupBy("anchor", "p1", "p2").agg(F.collect_set(F.struct("lo", "hi")).alias("places")))
    found = rows.select("k1", "k2", "at", "anchor", "p1", "p2").join(verdicts, ["anchor", "p1", "p2"])
    spans = F.transform(
        "places",
        lambda p: F.struct((F.col("at") - p["hi"]).alias("start"), (F.col("at") - p["lo"] + length).alias("end")),
    )
    return found.select("k1", "k2", F.explode(spans).alias("span")).groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def _strip(data: np.ndarray, offsets: np.ndarray, spans: pa.Array) -> pa.Array:
    spans = spans.fill_null([]) if spans.null_count else spans
    flat = spans.flatten()
    begin = np.repeat(offsets[:-1], np.diff(spans.offsets.to_numpy()))
    start, end = (flat.field(n).to_numpy(zero_copy_only=False) + begin for n in ("start", "end"))
    change = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change[:-1]) > 0
    opens = gone.copy()
    opens[1:] &= ~gone[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    opens[cuts] = gone[cuts]
    raw, kept = data[~gone].tobytes(), np.concatenate([[0], np.cumsum(~gone)])[offsets]
    return pa.StructArray.from_arrays(
        [
            pa.array(np.diff(offsets)),
            pa.array(W.per_text(gone, offsets)),
            pa.array(W.per_text(opens, offsets)),
            pa.array([raw[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)], pa.binary()),
        ],
        names=["n_bytes", "n_removed", "n_spans", "kept"],
    )


def strip_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    anchor: int = ANCHOR,
    bucket: int = BUCKET,
    into: str = "repeats",
) -> DataFrame:
    """``docs`` with a struct ``into``: n_bytes, n_removed, n_spans (maximal runs
    of removed bytes) and kept (the bytes left, which need not be whole characters).

    A byte goes if a string of ``length`` bytes that covers it also starts
    anywhere else, the same text included; strings are judged on the input. A
    null text is empty; a text shorter than ``length`` keeps all. Rows that are
    equal in doc_id and text repeat each other like any two. A column called
    ``into`` is replaced, others pass through; an empty table gives no rows. A
    text of a single repeated byte has an anchor, and a row, at every byte.
    """
    spans = store(repeated_spans(docs, doc_id, text, length, anchor, bucket))
    k1, k2, mark = fresh(docs, "__k1"), fresh(docs, "__k2"), fresh(docs, "__spans")
    one, two = _keys(doc_id, text)
    joined = docs.withColumns({k1: one, k2: two}).join(
        spans.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(mark)), [k1, k2], "left"
    ).select(*[F.col(f"`{n}`") for n in docs.columns if n != into], mark)
    kind = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"
    return add_struct(joined, text, into, kind, lambda: _strip, mark)


def digest(stripped: DataFrame, doc_id: str = "doc_id", into: str = "repeats") -> DataFrame:
    """One row per document: counts and a hash of the bytes left."""
    return stripped.select(
        F.col(doc_id).alias("doc_id"),
        F.col(f"`{into}`.n_bytes").alias("n_bytes"),
        F.col(f"`{into}`.n_removed").alias("n_removed"),
        F.col(f"`{into}`.n_spans").alias("n_spans"),
        F.sha2(F.col(f"`{into}`.kept"), 256).alias("kept_sha256"),
    )
