"""Registered queries over the given tables, each with its SQL twin."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# DuckDB widens sums to HUGEINT and counts positions in BIGINT; the columns
# below are cast to the types Spark gives them.
TYPES = {
    "BIGINT": {
        "catalogue_products": ("product_id",),
        "match_products": ("product_id",),
        "resolve_products": ("product_id",),
        "sweep_summary": ("deleted",),
        "progress_totals": ("total_ms",),
        "language_blocks": ("block", '"offset"'),
        "block_heads": ("block", "block_chars"),
        "manual_stats": ("chunks",),
        "page_languages": ("characters",),
        "labelled_pages": ("block", '"offset"'),
        "ingest_states": ("characters",),
        "chunk_texts": ("chars",),
        "chunk_places": ("first_page", "last_page"),
    },
    "INTEGER": {
        "progress_totals": ("done",),
        "page_quality": ("page", "chars"),
        "section_labels": ("page",),
        "labelled_pages": ("page", "chars"),
        "extractor_report": ("chars",),
        "vector_topk": ("rank",),
        "lexical_topk": ("rank",),
        "hybrid_rrf": ("rank",),
        "hybrid_blocks": ("rank",),
        "scoped_search": ("rank",),
        "merge_semantic": ("rank",),
        "search_manual": ("rank",),
        "grounding": ("invented",),
    },
}


def _typed(name: str, sql: str) -> str:
    casts = [
        f"CAST({column} AS {kind}) AS {column}"
        for kind, queries in TYPES.items()
        for column in queries.get(name, ())
    ]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})" if casts else sql


def check(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must agree with it."""

    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = _typed(name, sql)
        return function

    return keep


def load() -> None:
    """Import every module that registers queries."""
    from checks import (  # noqa: F401
        analytics,
        answers,
        approximate,
        catalogue,
        evaluation,
        ingest,
        lexemes,
        retrieval,
        threads,
    )
