"""Golden set and reports as files of JSON lines or YAML."""

import glob
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.operators.evals import METRICS, case_violation, compare_runs

CASE = (
    "id string, question string, brand string, model string, intent string, "
    "answerable boolean, expected_pages array<int>, expected_answer string, "
    "key_facts array<string>"
)
CASE_FIELDS = tuple(field.split()[0] for field in CASE.split(", "))
# Older reports lack some of these; an explicit schema reads them as NULL.
RESULT = (
    "id string, question string, product string, answerable boolean, "
    "intent_expected string, intent_actual string, recall boolean, correct boolean, "
    "covers boolean, invents boolean, judge_reason string, attempts int, "
    "cited_pages array<int>, key_facts_found string, grounded boolean, "
    "escalated boolean, best_similarity double, pages_retrieved array<int>, "
    "answer string, latency_ms int"
)
# The nine settings a run's numbers depend on.
CONFIG = (
    "pdf_backend", "chunk_size", "chunk_overlap", "embedding_model", "embedding_dimensions",
    "chat_model", "top_k", "min_similarity", "max_attempts",
)
REPORT = (
    "run_at string, config map<string,string>, summary map<string,double>, "
    f"cases array<struct<{RESULT}>>"
)


def _checked(cases: DataFrame) -> DataFrame:
    """Fail the job on a case of the wrong shape or an id used twice: a case
    skipped in silence would improve the numbers for the wrong reason."""
    problem = case_violation()
    shaped = cases.withColumn(
        "id",
        F.when(
            problem.isNotNull(), F.raise_error(F.concat_ws(": ", F.col("id"), problem)).cast("string")
        ).otherwise(F.col("id")),
    )
    twice = cases.groupBy("id").agg(F.count("*").alias("__n"))
    message = F.concat(F.lit("Duplicate case id "), F.col("id"))
    return (
        shaped.join(twice, "id")
        .withColumn(
            "id",
            F.when(F.col("__n") > 1, F.raise_error(message).cast("string")).otherwise(F.col("id")),
        )
        .select(*CASE_FIELDS)
    )


def _defaults(cases: DataFrame) -> DataFrame:
    none = F.array()
    return cases.withColumns(
        {
            "answerable": F.coalesce("answerable", F.lit(True)),
            "expected_pages": F.coalesce("expected_pages", none.cast("array<int>")),
            "key_facts": F.coalesce("key_facts", none.cast("array<string>")),
        }
    )


def read_cases(spark: SparkSession, folder: str) -> DataFrame:
    """All cases in a folder of JSON lines; a malformed line fails the read."""
    raw = spark.read.schema(CASE).option("mode", "FAILFAST").json(folder)
    return _checked(_defaults(raw))


def read_yaml_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Cases kept as YAML beside the code, a hand-written handful, sorted by
    file name."""
    import yaml

    rows = []
    for path in sorted(glob.glob(f"{folder}/*.yaml")):
        for entry in yaml.safe_load(Path(path).read_text()) or []:
            rows.append(tuple(entry.get(name) for name in CASE_FIELDS))
    return _checked(_defaults(spark.createDataFrame(rows, CASE)))


def run_stamp(run_at: Column) -> Column:
    """Time of a run as a file name."""
    return F.replace(run_at, F.lit(":"), F.lit("-"))


def write_report(
    summary: DataFrame, results: DataFrame, run_at: str, config: dict, folder: str
) -> None:
    """Keep a run: one partition per run with its settings, measures and cases.
    Writing a run again replaces it and leaves the others alone."""

    def keep(rows: DataFrame, name: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("run").json(f"{folder}/{name}")

    settings = F.create_map(
        *[F.lit(str(x)) for k in CONFIG for x in (k, config.get(k))]
    ).alias("config")
    stamped = [F.lit(run_at).alias("run_at"), run_stamp(F.lit(run_at)).alias("run")]
    keep(summary.select(*stamped, settings, "*"), "summary")
    keep(results.select(*stamped, "*"), "cases")


def read_results(spark: SparkSession, folder: str, ddl: str = RESULT) -> DataFrame:
    """Graded cases of all runs, with the run they belong to."""
    return spark.read.schema(f"{ddl}, run string").json(folder)


def latest_run(runs: DataFrame, before: str | None = None) -> DataFrame:
    """Rows of the last run by name, or of the last one before a given run."""
    if before is not None:
        runs = runs.where(F.col("run") < before)
    last = runs.agg(F.max("run").alias("run"))
    return runs.join(F.broadcast(last), "run", "left_semi")


def read_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Measures of all runs kept by ``write_report``, with the run they belong to."""
    measures = ", ".join(f"{name} double" for name in METRICS)
    return spark.read.schema(f"run_at string, {measures}, run string").json(f"{folder}/summary")


def report_summaries(reports: DataFrame) -> DataFrame:
    """The measures of whole reports (see read_reports) as columns. Older
    reports lack some: they are NULL."""
    named = {"recall": "recall@5"}
    measures = [F.col("summary")[named.get(name, name)].alias(name) for name in METRICS]
    return reports.select("run_at", "run", *measures)


def compare_with_last(summary: DataFrame, kept: DataFrame, before: str | None = None) -> DataFrame:
    """Each measure of ``summary`` beside that of the last run in ``kept`` (from
    read_summaries or report_summaries), or of the last before a given run.
    Without an earlier run there is nothing to compare with."""
    return compare_runs(summary, latest_run(kept, before))


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-report files, one JSON document each, as one row per report."""
    read = spark.read.schema(REPORT).option("multiLine", True).json(folder)
    return read.withColumn("run", run_stamp(F.col("run_at")))
