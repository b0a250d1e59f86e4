"""Split labelled pages into chunks, never across languages.

Pages of a language block are joined by an empty line before splitting, so a
chunk may span pages. No task ever holds a block: paragraphs are the pieces;
a long one is cut where it lies, in its own row; rows of short ones are packed
from their lengths alone, in bounded parts whose packing is linked through one
small summary per part.
"""

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from citeline.config import DEFAULTS
from citeline.functions import text as fx
from citeline.functions.arrow import bounded_batches, pieces
from citeline.operators.ordered import number_rows, running_sums
from citeline.operators.splitting import SEPARATORS, packing, split_spans
from citeline.session import settle

# Characters of a block that one task packs at a time.
PART_CHARS = 16_000_000
# Characters of a block that make one bucket of its ordered computations.
BUCKET_CHARS = 4_000_000
RUN = ["doc_id", "block", "run"]
SPAN = ["doc_id", "block", "start", "end", "page_from", "page_to", "page"]
# Marks in the summaries: wherever a part is entered; behind the run's end.
ANY, NOWHERE = -1, 2**62


@F.pandas_udf(T.ArrayType(T.LongType()))
def _sums_before(lengths: pd.Series) -> pd.Series:
    return lengths.map(lambda x: np.cumsum(x) - x, na_action="ignore")


def _with_pieces(pages: DataFrame, s) -> DataFrame:
    """Add ``pieces``: the paragraphs of a page and their place in the block.

    A piece carries the separator in front of it (``skip`` characters), unless
    it opens the block. Only pages of several paragraphs have to be looked
    into; cleaning leaves few of those.
    """
    join = len(s.page_join)
    several = F.contains(F.col("text"), F.lit(s.page_join))

    def piece(start: Column, length: Column) -> Column:
        skip = F.when(start > 0, F.lit(join)).otherwise(F.lit(0)).cast("long")
        return F.struct(
            (start - skip).alias("start"), (start + length).alias("end"), skip.alias("skip")
        )

    one = piece(F.col("offset").cast("long"), F.col("chars").cast("long"))
    whole = pages.where(~several).withColumn("pieces", F.array(one))
    sizes = F.transform(F.split("text", s.page_join), lambda p: F.length(p).cast("long"))
    cut = pages.where(several).withColumn("__sizes", sizes)
    cut = cut.withColumn("__before", _sums_before(F.transform("__sizes", lambda n: n + join)))
    cut = cut.withColumn(
        "pieces",
        F.transform(
            F.arrays_zip("__sizes", "__before"),
            lambda p: piece(F.col("offset") + p["__before"], p["__sizes"]),
        ),
    )
    return whole.unionByName(cut.drop("__sizes", "__before"))


def _added(rows: DataFrame, text: str, name: str, kind: str, work) -> DataFrame:
    """``rows`` with a column that ``work`` makes of each row's text and lists,
    in place of the text. Few texts are taken out of a batch at a time."""
    kept = [f for f in rows.schema.fields if f.name != text]
    made = T.StructField(name, T._parse_datatype_string(kind))
    arrow = to_arrow_type(made.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in pieces(whole, text)):
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(work(batch), arrow)], names=[*(f.name for f in kept), name]
            )

    return bounded_batches(rows).mapInArrow(run, T.StructType([*kept, made]))


def _spans(size: int, overlap: int):
    """Chunks of a paragraph. The text comes back with its place: cutting it
    by position in the JVM would walk from the paragraph's start each time."""

    def work(batch: pa.RecordBatch) -> list:
        return [
            [{"start": a, "content": p[a:b]} for a, b in split_spans(p, size, overlap, SEPARATORS[1:])]
            for p in batch.column("body").to_pylist()
        ]

    return work


def _slices(batch: pa.RecordBatch) -> list[list[str]]:
    """The parts of each text between the given positions, in one walk."""
    given = (batch.column(c).to_pylist() for c in ("text", "begins", "ends"))
    return [[text[a:b] for a, b in zip(begin, end, strict=True)] for text, begin, end in zip(*given, strict=True)]


def _long_chunks(pages: DataFrame, s) -> DataFrame:
    """Chunks of the paragraphs that are too long on their own."""
    start, end, skip = F.col("piece.start"), F.col("piece.end"), F.col("piece.skip")
    body = F.substring(
        F.col("text"),
        (start + skip - F.col("offset") + 1).cast("int"),
        (end - start - skip).cast("int"),
    )
    rows = (
        pages.where(F.col("chars") >= s.chunk_size - len(s.page_join))
        .withColumn("piece", F.explode("pieces"))
        .where(end - start >= s.chunk_size)
        .withColumn("body", F.concat(F.when(skip > 0, s.page_join).otherwise(""), body))
        .select("doc_id", "block", "page", start.alias("base"), "body")
    )
    cut = _added(rows, "body", "spans", "array<struct<start:long,content:string>>", _spans(s.chunk_size, s.chunk_overlap))
    return cut.withColumn("span", F.explode("spans")).select(
        "doc_id",
        "block",
        F.col("page").alias("page_from"),
        F.col("page").alias("page_to"),
        (F.col("base") + F.col("span.start")).alias("start"),
        "span.content",
    )


def _with_lookahead(pieces: DataFrame, s) -> DataFrame:
    """Each part also sees the pieces just behind its end."""
    part = F.floor(F.col("start") / PART_CHARS).cast("long")
    near = F.col("start") % PART_CHARS < 2 * s.chunk_size
    parts = F.when((part > 0) & near, F.array(part, part - 1)).otherwise(F.array(part))
    return pieces.withColumn("part", F.explode(parts))


def _exits(size: int, overlap: int):
    """Per part: at which offset of the next part packing arrives, for every
    offset at which it may enter this one."""

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("start")
        starts = rows["start"].to_numpy()
        border = (key[-1] + 1) * PART_CHARS
        _, follow = packing(starts, int(rows["end"].iloc[-1]), size, overlap)
        leave = np.full(len(starts) + 1, NOWHERE, dtype=np.int64)
        for i in range(len(starts) - 1, -1, -1):
            leave[i] = starts[i] if starts[i] >= border else leave[follow[i]]
        first = starts[0] if rows["first_part"].iloc[0] == key[-1] else key[-1] * PART_CHARS
        entries = np.flatnonzero((starts < border) & (starts <= first + size))
        exits = leave[entries]
        enter = starts[entries]
        if len(set(exits)) == 1:
            enter, exits = np.array([ANY]), exits[:1]
        out = {n: [k] * len(enter) for n, k in zip([*RUN, "part"], key)}
        return pd.DataFrame(out | {"enter": enter, "leave": exits})

    return run


def _link(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
    """Follow the parts of one run from its first offset."""
    at = int(rows["run_start"].iloc[0])
    parts, entries = [], []
    for part, some in rows.groupby("part", sort=True):
        parts.append(part)
        entries.append(at)
        ways = dict(zip(some["enter"], some["leave"]))
        if at < NOWHERE:
            at = int(ways[ANY] if ANY in ways else ways[at])
    out = {n: [k] * len(parts) for n, k in zip(RUN, key)}
    return pd.DataFrame(out | {"part": parts, "entry": entries})


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]):
    """Groups of rows that arrive sorted by ``keys``, whole, one at a time."""
    held = None
    for batch in batches:
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if not len(rows):
            continue
        changed = (rows[keys] != rows[keys].shift()).any(axis=1).to_numpy()
        at = np.flatnonzero(changed)
        for a, b in zip(at[:-1], at[1:]):
            yield rows.iloc[a:b]
        held = rows.iloc[at[-1] :]
    if held is not None:
        yield held


def _pack(size: int, overlap: int):
    """Chunks that start in each part, one row per chunk and page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for rows in _whole_groups(batches, [*RUN, "part"]):
            doc, block, part = rows["doc_id"].iat[0], rows["block"].iat[0], rows["part"].iat[0]
            starts, ends = rows["start"].to_numpy(), rows["end"].to_numpy()
            pages, skip = rows["page"].to_numpy(), rows["skip"].to_numpy()
            stop, follow = packing(starts, int(ends[-1]), size, overlap)
            border = (part + 1) * PART_CHARS
            at = int(np.searchsorted(starts, rows["entry"].iat[0]))
            while at < len(starts) and starts[at] < border:
                to = int(stop[at])
                span = (starts[at] + skip[at], ends[to - 1], pages[at], pages[to - 1])
                out += [(doc, block, *span, page) for page in dict.fromkeys(pages[at:to])]
                at = int(follow[at])
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=SPAN)
                out = []
        if out:
            yield pd.DataFrame(out, columns=SPAN)

    return run


def _place_bucket(start: Column) -> Column:
    """Bucket of an offset in a block. Offsets rise with pages and paragraphs,
    so a block is cut alike whether it is many pages or a single huge one."""
    return F.floor(start / BUCKET_CHARS).cast("long")


def _short_spans(pieces: DataFrame, s) -> DataFrame:
    """Pack rows of short paragraphs: doc_id, block, start, end, page_from,
    page_to and one row per page the chunk takes text from."""
    doc, page = pieces.schema["doc_id"].dataType, pieces.schema["page"].dataType
    long = (F.col("end") - F.col("start") >= s.chunk_size).cast("long")
    bucket = _place_bucket(F.col("start"))
    runs = settle(
        running_sums(
            pieces, ["doc_id", "block"], ["page", "para"], bucket, {"run": long}
        ).where(F.col("end") - F.col("start") < s.chunk_size)
    )
    part = F.floor(F.col("start") / PART_CHARS).cast("long")
    extent = settle(
        runs.groupBy(*RUN).agg(
            F.min("start").alias("run_start"),
            F.max("end").alias("run_end"),
            F.min_by("skip", "start").alias("run_skip"),
            F.min("page").alias("run_from"),
            F.max("page").alias("run_to"),
            F.min(part).alias("first_part"),
            F.max(part).alias("last_part"),
        )
    )
    runs = runs.join(extent, RUN)
    whole = F.col("run_end") - F.col("run_start") <= s.chunk_size
    spans = (
        runs.where(whole)
        .select(
            "doc_id", "block",
            (F.col("run_start") + F.col("run_skip")).alias("start"),
            F.col("run_end").alias("end"),
            F.col("run_from").alias("page_from"),
            F.col("run_to").alias("page_to"),
            "page",
        )
        .distinct()
    )
    parts = _with_lookahead(runs.where(~whole), s).where(
        F.col("part") >= F.col("first_part")
    )
    fields = T.StructType(
        [T.StructField("doc_id", doc)]
        + [T.StructField(n, T.LongType()) for n in ("block", "run", "part")]
    )
    several = parts.where(F.col("last_part") > F.col("first_part"))
    exits = several.groupBy(*RUN, "part").applyInPandas(
        _exits(s.chunk_size, s.chunk_overlap),
        T.StructType(
            fields.fields + [T.StructField(n, T.LongType()) for n in ("enter", "leave")]
        ),
    )
    entries = (
        exits.join(extent.select(*RUN, "run_start"), RUN)
        .groupBy(*RUN)
        .applyInPandas(_link, T.StructType(fields.fields + [T.StructField("entry", T.LongType())]))
    )
    placed = parts.join(entries, [*RUN, "part"], "left").withColumn(
        "entry", F.coalesce("entry", "run_start")
    )
    together = placed.repartition(*RUN, "part").sortWithinPartitions(*RUN, "part", "start")
    packed = together.mapInPandas(
        _pack(s.chunk_size, s.chunk_overlap),
        T.StructType(
            [T.StructField("doc_id", doc), T.StructField("block", T.LongType())]
            + [T.StructField(n, T.LongType()) for n in ("start", "end")]
            + [T.StructField(n, page) for n in ("page_from", "page_to", "page")]
        ),
    )
    return spans.unionByName(packed)


def _short_chunks(pages: DataFrame, pieces: DataFrame, s) -> DataFrame:
    spans = _short_spans(pieces, s)
    # A page meets its spans once, however many chunks take text from it.
    span = F.struct("block", "start", "end", "page_from", "page_to")
    wanted = settle(spans.groupBy("doc_id", "page").agg(F.collect_list(span).alias("spans")))
    text = pages.select("doc_id", "page", "offset", "chars", "text")

    def inside(place):
        place = F.greatest(F.least(place, F.col("offset") + F.col("chars")), F.col("offset"))
        return (place - F.col("offset")).cast("int")

    begins = F.transform("spans", lambda x: inside(x["start"]))
    ends = F.transform("spans", lambda x: inside(x["end"]))
    placed = text.join(wanted, ["doc_id", "page"]).select(
        "doc_id", "page", "spans", "text", begins.alias("begins"), ends.alias("ends")
    )
    cut = _added(placed, "text", "cut", "array<string>", _slices)
    parts = cut.select(
        "doc_id", "page", F.explode(F.arrays_zip("spans", "cut")).alias("x")
    ).select(
        "doc_id", "x.spans.block", "x.spans.start", "x.spans.page_from", "x.spans.page_to",
        "page", F.col("x.cut").alias("part"),
    )
    pieces = F.sort_array(F.collect_list(F.struct("page", "part")))
    whole = parts.groupBy("doc_id", "block", "start", "page_from", "page_to").agg(
        F.concat_ws(s.page_join, pieces["part"]).alias("content")
    )
    return whole.select("doc_id", "block", "page_from", "page_to", "start", "content")


def chunk_pages(pages: DataFrame, s=DEFAULTS) -> DataFrame:
    """Chunks of labelled pages.

    ``pages``: doc_id, page, text, chars, block, offset (``language_blocks``)
    and, for the labels, language and section. It is read by several branches,
    so pass a settled table. Returns doc_id, ordinal, page_from, page_to,
    language, section, content.
    """
    placed = _with_pieces(pages, s)
    pieces = placed.select("doc_id", "block", "page", F.posexplode("pieces").alias("para", "p"))
    pieces = pieces.select("doc_id", "block", "page", "para", "p.*")
    short = _short_chunks(pages, pieces, s)
    long = _long_chunks(placed, s)
    chunks = settle(
        short.unionByName(long)
        .withColumn("content", fx.strip(F.col("content")))
        .where(F.length("content") > 0)
    )
    heads = settle(
        pages.groupBy("doc_id", "block")
        .agg(F.min(F.struct("page", "language", "section")).alias("head"))
        .select("doc_id", "block", "head.language", "head.section")
    )
    # Numbered without their texts; blocks and offsets rise with the pages.
    numbered = number_rows(
        chunks.select("doc_id", "block", "start", "page_from"), ["doc_id"],
        ["page_from", "block", "start"],
        F.struct("block", _place_bucket(F.col("start")).alias("place")), "ordinal",
    )
    numbered = settle(numbered.join(heads, ["doc_id", "block"]).drop("page_from"))
    return chunks.join(numbered, ["doc_id", "block", "start"]).select(
        "doc_id", F.col("ordinal").cast("int").alias("ordinal"),
        "page_from", "page_to", "language", "section", "content",
    )
