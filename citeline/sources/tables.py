"""Views of parquet tables as the entities the operators work on."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline import ports
from citeline.functions import text as fx
from citeline.session import settle


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes of a table that may be dealt out anew: one split's worth.
SMALL_TABLE_BYTES = 128 * 1024 * 1024


def spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are heavy to work on. One of at most a split's worth
    of bytes may be a single file that only one core would read, so its rows are
    dealt out; a larger one is read in its own splits and never shuffled here."""
    listed = spark.read.format("binaryFile").load(f"{folder}/{name}.parquet").select("length")
    size = listed.agg(F.sum("length").alias("n")).first()["n"] or 0
    rows = table(spark, folder, name)
    return rows.repartition(spark.sparkContext.defaultParallelism) if size <= SMALL_TABLE_BYTES else rows


def line_pages(spark: SparkSession, folder: str) -> DataFrame:
    """One page per line of a document: doc_id, lang, page, raw."""
    docs = spread(spark, folder, "documents").select("doc_id", "lang", "text")
    return docs.select(
        "doc_id", "lang", F.posexplode(ports.split_pages(F.col("text"))).alias("pos", "raw")
    ).select("doc_id", "lang", (F.col("pos") + 1).alias("page"), "raw")


def document_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as the chunk table, with vectors from the embedder.

    The manual of a chunk is its source and language; a page range stands in
    for the passage's place. A document whose length is odd applies only to
    the product its vector is labelled with, when it has one.
    """
    docs = spread(spark, folder, "documents")
    labels = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("label").cast("long").alias("label")
    )
    odd = (F.col("n_chars") % 2 == 1) & F.col("label").isNotNull()
    chunks = docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("chunk_id"),
        F.concat_ws("-", "source", "lang").alias("manual_id"),
        F.col("doc_id").alias("ordinal"),
        (F.col("doc_id") % 50 + 1).alias("page_from"),
        (F.col("doc_id") % 50 + 1 + F.floor(F.col("n_chars") / 4000)).alias("page_to"),
        F.col("lang").alias("language"),
        F.col("text").alias("content"),
        F.when(odd, F.array("label")).alias("applies_to"),
    )
    return chunks


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """chunk_id and content of ``document_chunks``, in as many rows, without the join
    to the labels, which shuffles the texts where those are many. Only documents with
    several labels, which have a row for each, are looked up."""
    docs = spread(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    labels = table(spark, folder, "embeddings").groupBy(F.col("vec_id").alias("chunk_id"))
    several = settle(labels.agg(F.count("*").alias("labels")).where("labels > 1"))
    if several.isEmpty():
        return docs
    rows = F.explode(F.sequence(F.lit(1), F.coalesce("labels", F.lit(1)))).alias("row")
    return docs.join(several, "chunk_id", "left").select("chunk_id", "content", rows).drop("row")


def product_links(spark: SparkSession, folder: str) -> DataFrame:
    """Which products (vector labels) a manual covers."""
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "embeddings")
    return (
        docs.join(labels, docs.doc_id == labels.vec_id)
        .select(
            F.concat_ws("-", "source", "lang").alias("manual_id"),
            F.col("label").cast("long").alias("product_id"),
        )
        .distinct()
    )


def benchmark_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts as questions; the product is the label of the vector
    that carries the same number."""
    asked = table(spark, folder, "benchmark")
    labels = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("label").cast("long").alias("product_id")
    )
    return asked.join(labels, "item_id", "left").select(
        F.col("item_id").alias("question_id"),
        F.col("text").alias("question"),
        "product_id",
        fx.query_terms(F.col("text")).alias("terms"),
    )
