"""Periodic runs of words, found by branching squares in an enhanced suffix array.

A run is a stretch of words with a smallest period that neither neighbour
extends. Its last square branches: the word after it breaks the period. Such
squares are found among the suffixes that share a prefix as long as the square's
half (``suffixes.branching_squares``); each is rotated to the left as far as the
period holds, which gives the stretch. Squares of the same stretch are merged
into one run, whose period is the least of theirs: the others are its multiples.
No tree is built, and texts are taken in units of bounded size.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.llm import suffixes
from citeline.llm import words as W
from citeline.llm.arrays import let
from citeline.llm.columns import add_struct, lists

#: Words of a run, and times its period, at least.
LENGTH, TIMES = 24, 3

RESULT = "struct<n_words:bigint,runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"


def runs_of(code: np.ndarray, first: np.ndarray, length: int = LENGTH, times: int = TIMES) -> tuple[np.ndarray, ...]:
    """(start, end, period) of the runs of some texts given as codes of words,
    by start, then period."""
    s = suffixes.build(code, first)
    at, period = suffixes.branching_squares(s)
    end = at + 2 * period
    start = suffixes.rotated(s, at, period)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    good = np.ones(len(start), dtype=bool)
    good[1:] = (np.diff(start) != 0) | (np.diff(end) != 0)  # the least period of a stretch
    good &= end - start >= np.maximum(length, times * period)
    start, end, period = start[good], end[good], period[good]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _compute(length: int, times: int):
    def compute(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        words = W.split(data, offsets, W.SPACED)
        start, end, period = runs_of(words.codes[0], words.first, length, times)
        text = np.searchsorted(words.first, start, side="right") - 1
        joined, begin, stop = words.joined()
        change = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, end, -1)
        gone = np.cumsum(change[:-1]) > 0
        removed = W.per_text(gone, words.first)
        kept = []
        for i in range(len(offsets) - 1):
            a, b = words.first[i], words.first[i + 1]
            if a == b:
                kept.append(b"")
            elif not removed[i]:
                kept.append(joined[begin[a] : stop[b - 1]])
            else:
                edge = np.flatnonzero(np.diff(gone[a:b], prepend=True, append=True)) + a
                kept.append(b" ".join(joined[begin[x] : stop[y - 1]] for x, y in edge.reshape(-1, 2)))
        found = pa.StructArray.from_arrays(
            [pa.array(start - words.first[text]), pa.array(end - start), pa.array(period)],
            names=["start", "length", "period"],
        )
        return pa.StructArray.from_arrays(
            [
                pa.array(np.diff(words.first)),
                lists(found, np.bincount(text, minlength=len(offsets) - 1)),
                pa.array(kept, pa.binary()).cast(pa.string()),
            ],
            names=["n_words", "runs", "collapsed"],
        )

    return compute


def find_runs(
    docs: DataFrame, text: str = "text", length: int = LENGTH, times: int = TIMES, into: str = "runs"
) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, runs (structs of start, length
    and period, in words, by start, then period) and collapsed (the words left,
    joined by one space, when of each run only its first period is kept).

    A run has at least ``length`` words and ``times`` periods (2 or more). Words
    are parted by ASCII white space and compared by their bytes. A null text, an
    empty one and one of white space have no words and an empty ``collapsed``.
    Rows are taken for themselves, repeated ones too; a column called ``into`` is
    replaced, others pass through; an empty table gives no rows. A text is held
    by one task as long as it is worked on, with about 8 bytes per word for each
    doubling of its longest repeat.
    """
    if times < 2:
        raise ValueError("a run has two periods at least")
    return add_struct(docs, text, into, RESULT, lambda: _compute(length, times))


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with periodic tails: of each tenth text (by the CRC of its id),
    word i from a word on becomes the word (i - a) modulo a period after it. All
    are numbers of the CRC, so that results can be compared with other engines."""
    h = F.crc32(F.col(doc_id).cast("string"))
    g = F.floor(h / 10)

    def rebuilt(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")

        def shifted(ap: Column) -> Column:
            return F.transform(
                F.sequence(F.lit(0), n - 1),
                lambda i: F.get(w, F.when(i < ap["a"], i).otherwise(ap["a"] + (i - ap["a"]) % ap["p"])),
            )

        return F.when(n > 0, F.array_join(let(F.struct(a.alias("a"), p.alias("p")), shifted), " ")).otherwise(F.lit(""))

    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.withColumn(text, F.when(h % 10 == 0, let(words, rebuilt)).otherwise(F.col(text)))


def digest(found: DataFrame, doc_id: str = "doc_id", into: str = "runs") -> DataFrame:
    """One row per document: the number of its runs, the one of the greatest
    exponent (of equal ones the first), and hashes of all runs and of the words left."""
    held = found.select(F.col(doc_id).alias("doc_id"), f"`{into}`.*")
    ranked = F.transform(
        "runs",
        lambda r: F.struct(
            (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("s"), (-r["period"]).alias("p"), r["length"].alias("length")
        ),
    )
    best = F.array_max(ranked)
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return held.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
