"""Approximate nearest neighbours: vectors in cells, few cells read per question.

Centroids are fitted by k-means on unit vectors. Each chunk belongs to its
nearest centroid, so a partitioned table of cells lets a question read only
the ``probes`` cells nearest to it; within those, scoring is exact.

Vectors without clusters have their neighbours in most cells. For those there are
codes: all are read, at a quarter of the bytes, and vectors only of a shortlist.
"""

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeline.config import DEFAULTS
from citeline.operators.scoring import DECIMALS, VECTOR, unit_rows
from citeline.operators.search import rank_candidates, vector_topk
from citeline.session import settle


def fit_cells(chunks: DataFrame, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centroids, one row per cell; bounded by ``cells`` x dimensions."""
    vectors = chunks.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(vectors)
    centres = np.array(model.clusterCenters())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def label_cells(chunks: DataFrame, label: str = "label") -> np.ndarray:
    """Unit centroids as the mean vectors of known groups, in the order of their
    labels: one aggregate over all chunks. Bounded by labels x dimensions."""
    means = (
        chunks.select(label, F.posexplode("embedding").alias("at", "value"))
        .groupBy(label, "at")
        .agg(F.avg(F.col("value").cast("double")).alias("mean"))
        .groupBy(label)
        .agg(F.array_sort(F.collect_list(F.struct("at", "mean")))["mean"].alias("centre"))
    )
    rows = sorted((r[label], r["centre"]) for r in means.where(F.col(label).isNotNull()).collect())
    centres = np.array([centre for _, centre in rows])
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def write_cells(chunks: DataFrame, centroids: np.ndarray, path: str) -> DataFrame:
    """The chunk table partitioned by cell, for searches that read few cells."""
    assign_cells(chunks, centroids).write.mode("overwrite").partitionBy("cell").parquet(path)
    return chunks.sparkSession.read.parquet(path)


def nearest_cells(df: DataFrame, vector: str, centroids: np.ndarray, n: int, name: str) -> DataFrame:
    """Add ``name``: the n cells nearest to the vector, nearest first."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    fields = T.StructType(df.schema.fields + [T.StructField(name, T.ArrayType(T.IntegerType()))])

    def add(batches):
        centres = shared.value
        for batch in batches:
            near = np.nan_to_num(unit_rows(batch.column(vector), centres.shape[1])) @ centres.T
            best = np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1], pa.int32()),
                pa.array(best.reshape(-1), pa.int32()),
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists], names=[*batch.schema.names, name]
            )

    return df.mapInArrow(add, fields)


def assign_cells(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Chunks with their ``cell``: the column to partition the table by."""
    placed = nearest_cells(chunks, "embedding", centroids, 1, "__cells")
    return placed.withColumn("cell", F.get(F.col("__cells"), F.lit(0))).drop("__cells")


def ann_topk(
    chunks: DataFrame, questions: DataFrame, centroids: np.ndarray, probes: int, k: int
) -> DataFrame:
    """Top k within the probed cells. chunks: chunk_id, embedding, cell.

    A probed cell acts as the scope of a question, so this is the exact search
    on fewer chunks. The probed cells, no more than there are centroids, become
    a filter: a table partitioned by cell (``write_cells``) reads only those.
    """
    asked = nearest_cells(
        questions.select("question_id", "vector"), "vector", centroids, probes, "__cells"
    ).select("question_id", "vector", F.explode("__cells").alias("product_id"))
    probed = sorted(r[0] for r in asked.select("product_id").distinct().collect())
    near = chunks.where(F.col("cell").isin(probed)).withColumn("products", F.array("cell"))
    return rank_candidates(near, asked, (VECTOR,), k).drop("list_idx", "score")


def recall_against(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact neighbours that the approximate search found."""
    found = exact.select("question_id", "chunk_id").join(
        approximate.select("question_id", "chunk_id", F.lit(1).alias("hit")),
        ["question_id", "chunk_id"], "left",
    )
    return found.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


#: Steps on either side of zero that a number of a code may take.
CODE_STEPS = 127


def add_codes(chunks: DataFrame, into: str = "code") -> DataFrame:
    """Chunks with a code of one byte per number of the unit vector: a quarter of
    the bytes, so a table of codes is read in place of the vectors. Each code is
    scaled by the vector's largest number; a null or zero vector has no code."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    most = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    scaled = F.transform("embedding", lambda x: F.round(x.cast("double") / F.col("__most") * CODE_STEPS).cast("tinyint"))
    held = chunks.withColumns({"__norm": norm, "__most": most})
    good = F.col("__norm") > 0
    return held.withColumns(
        {into: F.when(good, scaled), f"{into}_scale": F.when(good, F.col("__most") / F.col("__norm") / CODE_STEPS).cast("float")}
    ).drop("__norm", "__most")


def coded_topk(
    coded: DataFrame, questions: DataFrame, vectors: DataFrame, k: int = 20, shortlist: int = 3, s=DEFAULTS
) -> DataFrame:
    """(question_id, chunk_id, similarity, rank): nearest chunks, found by their
    codes and ranked by their vectors.

    ``coded`` holds chunk_id, code and code_scale (``add_codes``), ``vectors``
    chunk_id and embedding. Every code is scored in one pass; the best
    ``shortlist`` * k of each question are looked up in ``vectors`` by id and scored
    exactly, so full vectors are read for those alone. The similarity is exact;
    a true neighbour is missed only if its code ranks beyond the shortlist.
    """
    approximate = F.transform("code", lambda x: x.cast("float") * F.col("code_scale"))
    codes = coded.select("chunk_id", F.when(F.col("code").isNotNull(), approximate).alias("embedding"))
    near = vector_topk(codes, questions, k * shortlist, s).select("question_id", "chunk_id")
    asked = questions.select("question_id", "vector")
    product = lambda a, b: F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda held, x: held + x
    )
    # few pairs per question against the table of vectors, by id
    pairs = settle(near).join(vectors.select("chunk_id", "embedding"), "chunk_id").join(asked, "question_id")
    similarity = product("embedding", "vector") / F.sqrt(product("embedding", "embedding")) / F.sqrt(product("vector", "vector"))
    order = Window.partitionBy("question_id").orderBy(F.round("similarity", DECIMALS).desc(), "chunk_id")
    ranked = pairs.select("question_id", "chunk_id", similarity.alias("similarity")).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)
