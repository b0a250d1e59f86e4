"""Batch forms of the tools an agent calls: search, ask, list."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.config import DEFAULTS
from citeline.operators import answer, search
from citeline.operators.catalog import chunk_counts
from citeline.operators.evals import resolve_products


def _scoped(queries: DataFrame, products: DataFrame) -> DataFrame:
    """Queries with the product they name; one that names none that is known
    searches everything."""
    return resolve_products(queries, products, strict=False)


def search_manual(
    queries: DataFrame,
    products: DataFrame,
    links: DataFrame,
    chunks: DataFrame,
    ports: answer.Ports = answer.Ports(),
    limit: int = DEFAULTS.top_k,
    s=DEFAULTS,
) -> DataFrame:
    """Extracts per query, without an answer. queries: question_id, question,
    brand, model. Returns question_id, rank, chunk_id, content, pages, language
    and similarity."""
    scoped = _scoped(queries, products).withColumn("search_question", F.col("question"))
    prepared = answer.prepare_questions(
        scoped.select("question_id", "search_question", "product_id"), ports
    )
    hits = search.hybrid_search(chunks, prepared, links, limit, s)
    return search.fetch_hits(hits, chunks).select(
        "question_id", "rank", "chunk_id", "content",
        F.concat_ws("-", "page_from", "page_to").alias("pages"),
        "language", F.round("similarity", 3).alias("similarity"),
    )


def ask_manual(
    queries: DataFrame,
    products: DataFrame,
    links: DataFrame,
    chunks: DataFrame,
    ports: answer.Ports = answer.Ports(),
    s=DEFAULTS,
) -> DataFrame:
    """Checked answers with citations; no thread, no log."""
    scoped = _scoped(queries, products).select("question_id", "question", "product_id")
    return answer.answer_questions(scoped, chunks, links, ports, s).select(
        "question_id", "answer", F.coalesce("intent", F.lit("")).alias("intent"),
        "grounded", "escalated", "citations",
    )


def list_manuals(manuals: DataFrame, chunks: DataFrame) -> DataFrame:
    """What is in the index: title, status and number of extracts."""
    return chunk_counts(manuals, chunks).select("title", "status", "chunks")
