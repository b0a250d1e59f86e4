"""Tables that grow by micro-batch, so that a replayed batch changes nothing."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.sources.files import missing_path


class BatchLog:
    """An append-only table with one partition per micro-batch.

    Writing a batch again (after a failure between the write and the stream's
    own commit) replaces its partition by the same rows: effectively once.
    Readers of batch n see the batches before it, never its own leftovers.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path = spark, path
        fields = T.StructType.fromDDL(ddl).fields
        self.schema = T.StructType(fields + [T.StructField("batch", T.LongType())])

    def write(self, rows: DataFrame, batch: int) -> None:
        names = [f.name for f in self.schema.fields if f.name != "batch"]
        (
            rows.select(*names)
            .withColumn("batch", F.lit(batch).cast("long"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch")
            .parquet(self.path)
        )

    def read(self, before: int | None = None) -> DataFrame:
        try:
            rows = self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if not missing_path(error):
                raise
            return self.spark.createDataFrame([], self.schema)
        return rows if before is None else rows.where(F.col("batch") < before)


class KeyedState:
    """What a stream must remember of its past: one row per key, not the past.

    The state after a batch is written whole, into one of two slots by turns, so
    that a replayed batch finds the state before it untouched. Reading it costs
    as much as there are keys, however old the stream is.
    """

    def __init__(self, spark: SparkSession, path: str, ddl: str):
        self.spark, self.path = spark, path
        fields = T.StructType.fromDDL(ddl).fields
        self.names = [f.name for f in fields]
        self.schema = T.StructType(
            [*fields, T.StructField("batch", T.LongType()), T.StructField("slot", T.IntegerType())]
        )

    def write(self, rows: DataFrame, batch: int) -> None:
        """The state after ``batch``; ``rows`` may be derived from ``read``."""
        (
            rows.select(*self.names, F.lit(batch).cast("long").alias("batch"), F.lit(batch % 2).alias("slot"))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("slot")
            .parquet(self.path)
        )

    def read(self, before: int | None = None) -> DataFrame:
        """The state before a batch, or the latest.

        A batch may be run again, so the state may be its own; one of a later batch
        belongs to another run of the stream, whose numbers this one does not follow.
        """
        try:
            rows = self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as error:
            if not missing_path(error):
                raise
            return self.spark.createDataFrame([], self.schema).select(*self.names)
        earlier = F.lit(True) if before is None else F.col("batch") < before
        found = rows.agg(F.max("batch").alias("newest"), F.max(F.when(earlier, F.col("batch"))).alias("last")).first()
        if before is not None and found["newest"] is not None and found["newest"] > before:
            raise ValueError(
                f"{self.path} holds the state after batch {found['newest']}, but the stream is at batch {before}: "
                "go on from the checkpoint of that state, or give the stream a path of its own"
            )
        last = found["last"]
        at = F.col("slot") == (last or 0) % 2
        return rows.where(at & (F.col("batch") == last)).select(*self.names)
