"""From raw pages to the chunk table: clean, label, split, embed, index."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeline import ports
from citeline.config import DEFAULTS
from citeline.functions import text as fx
from citeline.operators import chunking
from citeline.operators import pages as pg
from citeline.operators.catalog import page_languages
from citeline.session import settle

# Fixed value: what a document without any text is told.
SCANNED_MESSAGE = "This PDF has no extractable text. It looks scanned and would need OCR."


def label_pages(raw: DataFrame, detect: Callable[[DataFrame], DataFrame], s=DEFAULTS) -> DataFrame:
    """Usable pages with language, section, block and offset.

    raw: doc_id, page, raw. ``detect`` adds ``language`` to rows with a text;
    it sees usable pages only, and each of them once.
    """
    cleaned = pg.usable(pg.clean_pages(raw, s=s))
    detected = settle(detect(cleaned))
    narrow = detected.select("doc_id", "page", "language", "chars", "heading")
    blocks = pg.language_blocks(narrow, smooth=True, s=s)
    labels = pg.confirm_sections(blocks, s=s).select(
        "doc_id", "page", "language", "section", "block", "offset"
    )
    return detected.select("doc_id", "page", "text", "chars").join(labels, ["doc_id", "page"])


def ingest_pages(
    raw: DataFrame,
    detect: Callable[[DataFrame], DataFrame],
    embed: Callable[[DataFrame, str, str], DataFrame] = ports.embed,
    documents: DataFrame | None = None,
    s=DEFAULTS,
) -> dict[str, DataFrame]:
    """Pages in, chunk table and document states out.

    Returns ``pages`` (labelled), ``chunks`` (manual_id, ordinal, page_from,
    page_to, language, section_path, content, tokens, embedding, applies_to)
    and ``manuals`` (manual_id, status, error, page_count, chunk_count). A
    document without a usable page is a failed row, never a failed job.
    ``documents`` (doc_id, error) names those that may have no page at all.
    """
    labelled = settle(label_pages(raw, detect, s))
    cut = settle(chunking.chunk_pages(labelled, s))
    chunks = embed(cut, "content", "embedding").select(
        F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), "ordinal")).alias("chunk_id"),
        F.col("doc_id").alias("manual_id"),
        "ordinal",
        "page_from",
        "page_to",
        "language",
        F.col("section").alias("section_path"),
        "content",
        fx.tokens(F.col("content")).alias("tokens"),
        "embedding",
        F.lit(None).cast("array<string>").alias("applies_to"),
    )
    if documents is None:
        documents = raw.select("doc_id").distinct().withColumn("error", F.lit(None).cast("string"))
    n_pages = labelled.groupBy("doc_id").agg(F.count("*").alias("page_count"))
    n_chunks = cut.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    empty = F.col("page_count").isNull()
    manuals = (
        documents.join(n_pages, "doc_id", "left")
        .join(n_chunks, "doc_id", "left")
        .select(
            F.col("doc_id").alias("manual_id"),
            F.when(empty, "failed").otherwise("ready").alias("status"),
            F.when(
                empty, F.coalesce(F.left("error", F.lit(s.max_error_chars)), F.lit(SCANNED_MESSAGE))
            ).alias("error"),
            F.coalesce("page_count", F.lit(0)).alias("page_count"),
            F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
        )
    )
    return {"pages": labelled, "chunks": chunks, "manuals": manuals}


def ingest_files(
    files: DataFrame,
    detect: Callable[[DataFrame], DataFrame],
    extract: Callable[[Column], Column] = ports.text_pages,
    embed: Callable[[DataFrame, str, str], DataFrame] = ports.embed,
    s=DEFAULTS,
) -> dict[str, DataFrame]:
    """Stored files (doc_id, content) in, as ``ingest_pages`` out.

    ``extract`` gives struct(pages, error) per file and runs once per file.
    """
    extracted = settle(files.select("doc_id", extract(F.col("content")).alias("x")))
    raw = pg.pages_from_texts(extracted.select("doc_id", "x.pages"), "doc_id", F.col("pages"))
    documents = extracted.select("doc_id", "x.error")
    return ingest_pages(raw, detect, embed, documents, s)


def ingest_report(pages: DataFrame, chunks: DataFrame, s=DEFAULTS) -> DataFrame:
    """What each step produced, per document: pages, characters, languages by
    pages, chunks and their mean length (whole numbers, 0 without chunks)."""
    languages = page_languages(pages, "doc_id")
    sizes = chunks.groupBy(F.col("manual_id").alias("doc_id")).agg(
        F.count("*").alias("chunks"), F.sum(F.length("content")).alias("__chars")
    )
    return languages.join(sizes, "doc_id", "left").select(
        "doc_id", "characters", "languages",
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce(F.floor(F.col("__chars") / F.col("chunks")), F.lit(0)).alias("avg_chars"),
    )


def extraction_report(documents: DataFrame, doc: str, column: str) -> DataFrame:
    """The same document through every extractor: characters, spaces and
    control characters in percent."""
    texts = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("backend"), extract(F.col(column)).alias("text"))
                for name, extract in ports.EXTRACTORS.items()
            ]
        )
    )
    return documents.select(doc, texts.alias("x")).select(
        doc, "x.backend", F.length("x.text").alias("chars"),
        fx.space_pct(F.col("x.text")).alias("space_pct"),
        fx.control_pct(F.col("x.text")).alias("control_pct"),
    )
