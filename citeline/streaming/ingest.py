"""New files as they arrive: extract, ingest, replace their chunks."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from citeline import ports
from citeline.config import DEFAULTS
from citeline.operators import catalog
from citeline.plans.ingest import ingest_files
from citeline.sources.files import stored_key, write_chunks
from citeline.streaming.log import BatchLog

MANUAL_DDL = (
    "manual_id string, status string, error string, page_count long, chunk_count long"
)


def file_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """Stored files as a stream: storage_key, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("maxFilesPerTrigger", per_batch)
        .load(folder)
    )
    return files.select(stored_key(), "length", "content")


def ingest_stream(
    files: DataFrame,
    chunk_path: str,
    manuals: BatchLog,
    detect: Callable[[DataFrame], DataFrame],
    extract: Callable[[Column], Column] = ports.text_pages,
    embed: Callable[[DataFrame, str, str], DataFrame] = ports.embed,
    buckets: int = 256,
    s=DEFAULTS,
) -> DataStreamWriter:
    """Ingest each micro-batch of files and replace the chunks of its
    documents. A file is its content: the checksum names the document, so a
    redelivered or repeated file rewrites the same rows."""

    def run(batch: DataFrame, number: int) -> None:
        files = batch.select(
            catalog.checksum(F.col("content")).alias("doc_id"), "content"
        ).dropDuplicates(["doc_id"])
        result = ingest_files(files, detect, extract, embed, s)
        write_chunks(result["chunks"], chunk_path, buckets)
        manuals.write(result["manuals"], number)

    return files.writeStream.foreachBatch(run)
