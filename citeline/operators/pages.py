"""Pages: cleaning, filtering, language and section labels, language blocks.

The window work runs on narrow rows (no text); the text is joined back once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline.config import DEFAULTS
from citeline.functions import text as fx
from citeline.operators.ordered import int_bucket, neighbours, running_sums
from citeline.session import settle


def pages_from_texts(docs: DataFrame, doc: str, texts: Column) -> DataFrame:
    """One row per page, numbered from 1 as the reader sees them."""
    return docs.select(doc, F.posexplode(texts).alias("pos", "raw")).select(
        doc, (F.col("pos") + 1).alias("page"), "raw"
    )


def clean_pages(
    pages: DataFrame, paragraphs: str = "bullets", s=DEFAULTS
) -> DataFrame:
    """Cleaned text, its length, heading candidate and drop reason per page.

    Unusable pages stay as rows with a reason; ``usable`` keeps the others
    under their original numbers.
    """
    kept = [c for c in pages.columns if c != "raw"]
    # Exploding an array of one keeps the optimizer from copying the cleaning
    # into every expression (and filter) that reads the cleaned text.
    once = F.explode(F.array(fx.clean_text(F.col("raw"), paragraphs)))
    return pages.select(*kept, once.alias("text")).select(
        *kept,
        "text",
        F.length("text").alias("chars"),
        fx.heading_candidate(F.col("text"), s).alias("heading"),
        fx.drop_reason(F.col("text"), s).alias("reason"),
    )


def usable(pages: DataFrame) -> DataFrame:
    return pages.where(F.col("reason").isNull()).drop("reason")


def _majority(frame: Column) -> Column:
    """The strict majority of an array, or NULL. It is unique, so no rule for
    ties is needed."""
    often = F.filter(
        F.array_distinct(frame),
        lambda lang: F.size(F.filter(frame, lambda x: x == lang)) > F.floor(F.size(frame) / 2),
    )
    return F.get(often, F.lit(0))


def mark_blocks(
    pages: DataFrame,
    doc: str = "doc_id",
    page: str = "page",
    smooth: bool = True,
    s=DEFAULTS,
) -> DataFrame:
    """Replace one-off detections in ``language`` by the majority of the pages
    around (``smooth``), and mark where a run of one language ``opens``.

    One pass: the frame is a page wider than smoothing needs, so that the page
    before can be smoothed from the same array.
    """
    width = s.smoothing_window if smooth else 0
    around = neighbours(
        pages, [doc], page, int_bucket(F.col(page), s), "language", width + 1, "__around"
    )
    frame, before = F.col("__around"), F.col("__around_before")

    def label(place: Column) -> Column:
        own = F.get(frame, place)
        if not smooth:
            return own
        low = F.greatest(place - width, F.lit(0))
        return F.coalesce(_majority(F.slice(frame, low + 1, place + width - low + 1)), own)

    mine, previous = label(before), label(before - 1)
    opens = (before == 0) | (mine != previous)
    return around.withColumns({"language": mine, "opens": opens.cast("long")}).drop(
        "__around", "__around_before"
    )


def smooth_languages(
    pages: DataFrame, doc: str = "doc_id", page: str = "page", s=DEFAULTS
) -> DataFrame:
    """``language`` with one-off detections replaced by the local majority."""
    return mark_blocks(pages, doc, page, True, s).drop("opens")


def confirm_sections(
    pages: DataFrame, doc: str = "doc_id", s=DEFAULTS
) -> DataFrame:
    """Keep a heading only when it repeats within its document: ``section``.

    An aggregate with a join rather than a window: the counts combine before
    the shuffle, and a heading that fills a third of the pages is one row of
    the counted side, so the join may split the other side.
    """
    repeated = settle(
        pages.where(F.col("heading").isNotNull())
        .groupBy(doc, "heading")
        .agg(F.count("*").alias("__n"))
        .where(F.col("__n") >= s.min_section_repeats)
        .select(doc, "heading", F.col("heading").alias("section"))
    )
    return pages.join(repeated, [doc, "heading"], "left")


def number_blocks(
    marked: DataFrame, doc: str = "doc_id", page: str = "page", s=DEFAULTS
) -> DataFrame:
    """Number marked runs (``block``, from 0) and locate each page in its
    block: ``offset`` in characters when pages are joined."""
    width = F.col("chars") + len(s.page_join)
    opened = F.col("opens")
    placed = running_sums(
        marked, [doc], [page], int_bucket(F.col(page), s),
        {"__cursor": width.cast("long"), "__before": opened},
    ).withColumn("block", F.col("__before") + opened - 1)
    # The block's own start: an aggregate, so a block of any length is one row.
    starts = settle(placed.groupBy(doc, "block").agg(F.min("__cursor").alias("__start")))
    return (
        placed.join(starts, [doc, "block"])
        .withColumn("offset", F.col("__cursor") - F.col("__start"))
        .drop("__cursor", "__before", "__start", "opens")
    )


def language_blocks(
    pages: DataFrame,
    doc: str = "doc_id",
    page: str = "page",
    smooth: bool = False,
    s=DEFAULTS,
) -> DataFrame:
    """Blocks of consecutive pages in one language, smoothed first if asked.

    The marked rows are narrow and read by three branches: settled in between.
    """
    marked = settle(mark_blocks(pages, doc, page, smooth, s))
    return number_blocks(marked, doc, page, s)


def block_heads(
    pages: DataFrame, doc: str = "doc_id", page: str = "page"
) -> DataFrame:
    """Per block: language and section of its first page, page range, size."""
    first = F.struct(page, "language", "section")
    return pages.groupBy(doc, "block").agg(
        F.min(first)["language"].alias("language"),
        F.min(first)["section"].alias("section"),
        F.min(page).alias("first_page"),
        F.max(page).alias("last_page"),
        F.count("*").alias("n_pages"),
        F.max(F.col("offset") + F.col("chars")).alias("block_chars"),
    )
