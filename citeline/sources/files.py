"""Stored files as tables: bytes, listings, and the chunk sink."""

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.config import DEFAULTS
from citeline.session import settle


def missing_path(error: AnalysisException) -> bool:
    """Whether a read failed because there is no table yet; any other failure
    must not be taken for an empty table."""
    return error.getCondition() == "PATH_NOT_FOUND"


def stored_key() -> Column:
    """Key of a stored file: its name in the folder."""
    return F.element_at(F.split("path", "/"), -1).alias("storage_key")


def read_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Stored files with their bytes: storage_key, modified, length, content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(
        stored_key(), F.col("modificationTime").alias("modified"), "length", "content"
    )


def list_keys(spark: SparkSession, folder: str, now: Column, min_age_seconds: int = 0) -> DataFrame:
    """Keys of files no younger than an age. The bytes are never read: the
    scan is pruned to the listing."""
    files = spark.read.format("binaryFile").load(folder)
    old = F.col("modificationTime") <= now - F.make_dt_interval(secs=F.lit(min_age_seconds))
    return files.where(old).select(stored_key())


def list_sweepable(spark: SparkSession, folder: str, now: Column, s=DEFAULTS) -> DataFrame:
    """Files old enough that no running upload can still be about to name them."""
    return list_keys(spark, folder, now, s.orphan_min_age_seconds)


def unlinker(folder: str) -> Callable[[Column], Column]:
    """For ``catalog.sweep``: deletes the file of a key from a folder (a path or URI
    that every executor can reach) and says whether it is gone. A file that is not
    there is gone; a key that is not a plain name, or a failure, deletes nothing."""

    @F.pandas_udf(T.BooleanType())
    def gone(keys: pd.Series) -> pd.Series:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)

        def delete(key):
            if not key or "/" in key or "\\" in key or key in (".", ".."):
                return False
            at = f"{root.rstrip('/')}/{key}"
            try:
                kind = store.get_file_info(at).type
                if kind == fs.FileType.File:
                    store.delete_file(at)
                return kind in (fs.FileType.File, fs.FileType.NotFound)
            except OSError:
                return False

        return keys.map(delete).astype(bool)

    return gone


def write_chunks(chunks: DataFrame, path: str, buckets: int = 256) -> None:
    """Replace the chunks of the documents in ``chunks``; leave others alone.

    The table is partitioned by a hash of the document, and only partitions
    that hold one of these documents are rewritten, together with what they
    held of other documents. The new partitions take their place in one commit.
    """
    spark = chunks.sparkSession
    part = F.pmod(F.xxhash64("manual_id"), F.lit(buckets)).cast("int")
    # Settled: the rows, their partitions and their documents are all read, and
    # the embedding behind them must run once.
    new = settle(chunks.withColumn("part", part))
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException as error:
        if not missing_path(error):
            raise
        old = None
    if old is not None:
        touched = new.select("part").distinct()
        done = new.select("manual_id").distinct()
        kept = old.join(F.broadcast(touched), "part", "left_semi").join(
            done, "manual_id", "left_anti"
        )
        # The partitions about to be replaced are read first.
        new = settle(kept.select(*new.columns).unionByName(new))
    (
        new.repartition("part")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("part")
        .parquet(path)
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("part")
