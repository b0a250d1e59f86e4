"""Near-duplicates by SimHash, without a list of pairs.

A fingerprint is embedded as the numbers of set bits in its 32 segments of two
bits. Coarser segments make fewer cells per fingerprint, but unrelated ones then
meet by chance, and ever more of them as the corpus grows. Two fingerprints that differ in d bits lie at most d apart there in
Manhattan distance, so a range join on the grid of these points loses no link.
The range of 2 is split in the middle: every fingerprint is put into its own
cell and the cells one step away, and two within the range share one of them.
Only fingerprints that share a cell with another one go on. They are verified
exactly in the same manner: two differ in at most 2 bits if and only if they
share a word reached by changing at most one bit in each, and all that share
one are linked to the least of them. Both steps make a fixed number of rows per
fingerprint however many lie together, so a group of a thousand near copies
costs no more than a thousand single texts.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm import words as W
from citeline.llm.columns import add_struct, fresh
from citeline.llm.graph import components
from citeline.llm.tables import store

#: Words of a shingle.
SHINGLE = 3
SEGMENTS, SEGMENT_BITS = 32, 2
#: Prints that one task spreads over their cells, about.
PRINTS = 50_000
_HASHES = 1 << 17


def _fingerprints(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    words = W.split(data, offsets, W.SPACED_LOWER)
    joined, start, end = words.joined()
    size = np.diff(words.first)
    full = np.flatnonzero(W.inside_one(words, SHINGLE))
    short = np.flatnonzero((size > 0) & (size < SHINGLE))
    owner = np.concatenate([words.owner()[full], short])
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    a = np.concatenate([start[full], start[words.first[short]]])[order]
    b = np.concatenate([end[full + SHINGLE - 1], end[words.first[short + 1] - 1]])[order]
    ones = np.zeros((len(size), 64), dtype=np.int64)
    for low in range(0, len(owner), _HASHES):
        part = slice(low, low + _HASHES)
        hashes = np.fromiter(
            (
                xxhash.xxh64_intdigest(joined[i:j], 42)
                for i, j in zip(a[part].tolist(), b[part].tolist(), strict=True)
            ),
            dtype=np.uint64,
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[part]
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        ones[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    total = np.bincount(owner, minlength=len(size))
    set_bits = (2 * ones > total[:, None]).astype(np.uint8)
    packed = np.packbits(set_bits, axis=1, bitorder="little")
    return pa.array(np.ascontiguousarray(packed).view(np.int64).reshape(-1))


def add_fingerprint(docs: DataFrame, text: str = "text", into: str = "simhash") -> DataFrame:
    """``docs`` with the 64-bit fingerprint of each whole text as a bigint.

    Words are parted by ASCII white space and lower-cased in A-Z; a text of one
    or two words is one shingle; a null text or one without words has
    fingerprint zero.
    """
    return add_struct(docs, text, into, "bigint", lambda: _fingerprints)


def _signed(bits: int) -> Column:
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def cell(fingerprint: Column) -> Column:
    """Numbers of set bits by segment, each a digit of two bits."""
    low = F.lit(0x5555555555555555)
    one = fingerprint.bitwiseAND(low)
    other = F.shiftrightunsigned(fingerprint, 1).bitwiseAND(low)
    return one.bitwiseXOR(other).bitwiseOR(F.shiftleft(one.bitwiseAND(other), 1))


def cells_within_one(fingerprint: Column) -> Column:
    """The fingerprint's cell and the cells at Manhattan distance 1.

    A digit is 0, 1 or 2. Its lowest bit changes between 0 and 1, and both bits
    change between 1 and 2, so a step is an exclusive or.
    """
    own = cell(fingerprint)
    near = [own]
    for i in range(SEGMENTS):
        at = SEGMENT_BITS * i
        digit = F.shiftrightunsigned(own, at).bitwiseAND(3)
        near.append(F.when(digit < 2, own.bitwiseXOR(_signed(1 << at))))
        near.append(F.when(digit > 0, own.bitwiseXOR(_signed(3 << at))))
    return F.array_compact(F.array(*near))


def words_within_one(fingerprint: Column) -> Column:
    """The fingerprint and the 64 words that differ from it in one bit."""
    return F.array(fingerprint, *[fingerprint.bitwiseXOR(_signed(1 << i)) for i in range(64)])


def _meeting(prints: DataFrame, places: Column) -> tuple[DataFrame, DataFrame]:
    """(all, shared): the places of each print, and the places where two or
    more different ones meet, with the least of them."""
    # 65 rows per print: dealt out first, as a scan's task may hold millions of them,
    # and to all cores at any size; a single part would make the next steps one task's
    cores = prints.sparkSession.sparkContext.defaultParallelism
    parts = max(cores, -(-prints.count() // PRINTS))
    spread = prints.repartition(parts, "fp").select("fp", F.explode(places).alias("place"))
    shared = (
        spread.groupBy("place")
        .agg(F.min("fp").alias("least"), F.max("fp").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("place", "least")
    )
    return spread, store(shared)


def link(prints: DataFrame) -> DataFrame:
    """(a, b): each fingerprint of ``prints`` (column fp, distinct) that is not
    the least of its group, with the least one. Groups are the components under
    links of at most 2 differing bits."""
    spread, dense = _meeting(prints, cells_within_one(F.col("fp")))
    # the cells that meet grow with the corpus: never sent whole to every task
    close = store(spread.join(dense.select("place").hint("merge"), "place", "left_semi").select("fp").distinct())
    spread, shared = _meeting(close, words_within_one(F.col("fp")))
    stars = spread.join(shared, "place").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return components(stars)


def group(rows: DataFrame, doc_id: str = "doc_id", simhash: str = "simhash") -> DataFrame:
    """(fp, root, component_id) for each fingerprint of ``rows``: the least
    fingerprint of its group, and the smallest doc_id there (null if all are)."""
    prints = store(
        rows.groupBy(F.col(simhash).alias("fp")).agg(F.min(F.col(doc_id)).alias("least_id"))
    )
    linked = link(prints.select("fp"))
    rooted = store(
        prints.join(linked.select(F.col("a").alias("fp"), F.col("b").alias("other")), "fp", "left").select(
            "fp", "least_id", F.coalesce("other", "fp").alias("root")
        )
    )
    named = store(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")))
    return store(rooted.join(named, "root").select("fp", "root", "component_id"))


def near_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", into: str = "simhash"
) -> DataFrame:
    """One row per document: doc_id, ``into`` (fingerprint), component_id.

    Exact copies share a fingerprint and are one point of the graph, so copies
    are never paired. Texts without words (null, empty) link among themselves
    and to any fingerprint within 2 bits of zero. Rows that repeat a doc_id each
    get their component; an empty table gives no rows.
    """
    rows = store(add_fingerprint(docs.select(doc_id, text), text, into).select(doc_id, into))
    groups = group(rows, doc_id, into)
    return rows.join(groups.select(F.col("fp").alias(into), "component_id"), into).select(
        doc_id, into, "component_id"
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that of the smallest
    doc_id (null only where a group has no other), the first of several rows
    with the same one. All columns are kept as they are."""
    names, mark = docs.columns, fresh(docs, "__simhash")
    row = fresh(docs, "__row")
    numbered = add_fingerprint(docs, text, mark).withColumn(row, F.monotonically_increasing_id())
    held = store(numbered)
    rows = held.select(
        F.col(doc_id).alias("id"), F.col(mark).alias("fp"), F.col(row).alias("__row")
    )
    groups = group(rows, "id", "fp")
    placed = rows.join(groups, "fp")
    least = placed.where(F.col("id").eqNullSafe(F.col("component_id")))
    first = store(least.groupBy("root").agg(F.min("__row").alias("__row")))
    gone = store(rows.select("__row").join(first.select("__row"), "__row", "left_anti"))
    return held.join(gone.withColumnRenamed("__row", row), row, "left_anti").select(*[F.col(f"`{n}`") for n in names])


def digest(grouped: DataFrame, doc_id: str = "doc_id", simhash: str = "simhash") -> DataFrame:
    """One row per document, with the fingerprint as 16 hexadecimal digits."""
    return grouped.select(
        doc_id, F.lower(F.lpad(F.hex(F.col(simhash)), 16, "0")).alias("fingerprint"), "component_id"
    )
