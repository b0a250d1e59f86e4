"""Running the golden set, and checking the judge on stored answers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline import ports as default_ports
from citeline.config import DEFAULTS
from citeline.operators import answer, evals
from citeline.session import settle


def run_cases(
    cases: DataFrame,
    products: DataFrame,
    chunks: DataFrame,
    links: DataFrame,
    ports: answer.Ports = answer.Ports(),
    judge=default_ports.overlap_judge,
    embedded: DataFrame | None = None,
    s=DEFAULTS,
) -> DataFrame:
    """Every case through the answer flow, graded; one row per case.

    ``embedded`` is the chunk table with vectors, when ``chunks`` has none.
    """
    resolved = settle(evals.resolve_products(cases, products))
    asked = resolved.select(F.col("id").alias("question_id"), "question", "product_id")
    answers = settle(
        answer.answer_questions(
            asked, chunks if embedded is None else embedded, links, ports, s
        )
    )
    cited = answers.select(
        F.col("question_id").alias("id"),
        F.transform("citations", lambda c: c["page"].cast("long")).alias("cited"),
    )
    return evals.case_results(resolved, answers, _sources(resolved, cited, chunks, links, s), judge)


def _sources(cases, cited, chunks, links, s) -> DataFrame:
    """Text of the expected and the cited pages of the answerable cases."""
    pages = F.array_union(
        F.col("expected_pages").cast("array<bigint>"),
        F.coalesce("cited", F.array().cast("array<bigint>")),
    )
    wanted = cases.where("answerable").join(cited, "id", "left").select(
        "id", "product_id", pages.alias("pages")
    )
    return evals.source_texts(wanted, chunks, links, s)


def judge_consistency(
    stored: DataFrame,
    cases: DataFrame,
    products: DataFrame,
    chunks: DataFrame,
    links: DataFrame,
    judge=default_ports.overlap_judge,
    rounds: int = DEFAULTS.judge_rounds,
    s=DEFAULTS,
) -> tuple[DataFrame, DataFrame]:
    """Grade stored answers several times: overall stability, unstable cases.

    stored: id, answer, cited_pages of one run. Results whose case is gone are
    left out; the answers are not produced again, so only the judge varies.
    """
    resolved = settle(evals.resolve_products(cases, products))
    cited = stored.select("id", F.col("cited_pages").cast("array<bigint>").alias("cited"))
    sources = _sources(resolved, cited, chunks, links, s)
    rows = (
        stored.select("id", "answer")
        .join(resolved.select("id", "question", "expected_answer", "answerable"), "id")
        .join(sources, "id", "left")
        .withColumn("source", F.coalesce("source", F.lit("")))
    )
    return evals.consistency(settle(evals.judge_rounds(rows, judge, rounds)))
