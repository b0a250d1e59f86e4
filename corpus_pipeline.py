"""A training corpus from the documents table: five stages, each one operator.

Every stage works on all that the one before it kept; each result is written as
Parquet and read again, so a stage is planned on files of known size and a lost
executor never costs more than the stage at hand. All stages but the last
return the columns of their input. Null and empty texts, repeated rows, empty
tables and further columns are handled by the operators as their docstrings say.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeline.llm import decontaminate, mixing, pii, quality, simhash
from citeline.llm.columns import fresh
from citeline.llm.tables import store
from citeline.session import shared_folder

#: SQL cannot fit the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, accepts."""
    names = docs.columns
    counted = store(quality.add_features(docs.select("doc_id", "text"), into="counts").drop("text"))
    model = quality.train(counted, _table(spark, sf_dir, "labels"))
    mark = fresh(docs, "__quality")
    scored = quality.add_score(docs, model, into=mark)
    return scored.where(F.col(mark)["predicted"] == 1).select(*[F.col(f"`{n}`") for n in names])


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a window of any ``benchmark`` item."""
    names, mark = docs.columns, fresh(docs, "__hits")
    found = decontaminate.search_items(docs, _table(spark, sf_dir, "benchmark"), into=mark)
    return found.where(F.col(mark)["n_hit"] == 0).select(*[F.col(f"`{n}`") for n in names])


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind; n_chars,
    where there is such a column, follows the new text."""
    names, mark = docs.columns, fresh(docs, "__pii")
    found = pii.find(docs, into=mark)
    out = found.withColumn("text", pii.redacted(F.col("text"), F.col(mark)))
    if "n_chars" in names:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        changed = F.size(F.col(mark)) > 0
        out = out.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{n}`") for n in names])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated towards flatter shares of the sources, in a random order."""
    return mixing.mix(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", keep_one_of_near),
    ("benchmark decontamination", drop_contaminated),
    ("PII", hide_personal_data),
    ("mixing sources to target weights", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        path = f"{folder}/{i}"
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
