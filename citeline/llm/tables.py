"""Intermediate tables of long jobs."""

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from citeline.session import settle, shared_path

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Jobs run here free their shuffle files as soon as they end."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def store(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table outlives any executor. The shuffle files that made it are freed
    as soon as it is written, so a job of many steps holds those of one step.
    A table at a ``place`` taken before a ``scratch`` outlives that scope too.
    """
    spark = df.sparkSession
    with freed_shuffles(spark):
        if path is None:
            return settle(df)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)


def place(spark: SparkSession) -> str:
    """A path for ``store``, which belongs to the scope that is open now."""
    return shared_path(spark)
