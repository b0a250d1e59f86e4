"""Approximate neighbours: what is found beside the exact search."""

from pyspark.sql import functions as F

from checks import check
from citeline.operators import ann, search
from citeline.session import settle, shared_path
from citeline.sources.tables import table

#: Label cells, of ten, that hold nine tenths of the true neighbours: seven hold
#: 0.86 and 0.87 of them on sf0.01 and sf0.1, eight 0.92 on both.
WIDE = 8

CELLS_SQL = """
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
mean AS (SELECT label, i, avg(e[i]) AS m FROM v, range(1, 65) t(i) GROUP BY ALL),
centre AS (SELECT label, list(m ORDER BY i) AS c FROM mean GROUP BY label),
placed AS (SELECT vec_id, any_value(e) AS e, arg_max(c.label, list_cosine_similarity(e, c)) AS cell FROM v, centre c GROUP BY vec_id),
asked AS (SELECT item_id AS question_id, e AS q FROM benchmark JOIN v ON vec_id = item_id),
probe AS (SELECT question_id, q, label AS cell FROM asked, centre
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY list_cosine_similarity(q, c) DESC) <= 4),
found AS (SELECT question_id, vec_id AS chunk_id, list_cosine_similarity(q, e) AS similarity FROM probe JOIN placed USING (cell)
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(similarity, 9) DESC, vec_id) <= 20),
exact AS (SELECT question_id, vec_id AS chunk_id, list_cosine_similarity(q, e) AS similarity FROM asked, v
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(similarity, 9) DESC, vec_id) <= 20)"""


@check(
    "ann_topk",
    f"""WITH {CELLS_SQL}
SELECT question_id, chunk_id, round(f.similarity, 6) AS similarity, x.chunk_id IS NOT NULL AS exact
FROM exact f LEFT JOIN exact x USING (question_id, chunk_id)""",
)
def ann_topk(spark, folder):
    """Top 20 from codes of one byte per number, three times as many looked up by
    their vectors, and which of them the exact search finds too."""
    chunks, asked = _chunks_and_questions(spark, folder)
    codes = settle(ann.add_codes(chunks).select("chunk_id", "code", "code_scale"))
    return _beside_exact(ann.coded_topk(codes, asked, chunks), chunks, asked)


@check(
    "ann_topk_cells",
    f"""WITH {CELLS_SQL}
SELECT question_id, chunk_id, round(f.similarity, 6) AS similarity, x.chunk_id IS NOT NULL AS exact
FROM found f LEFT JOIN exact x USING (question_id, chunk_id)""",
)
def ann_topk_cells(spark, folder):
    """The same from the nearest four of the label cells, which hold six tenths of
    the true neighbours: quick rather than whole."""
    return _probed(spark, folder, 4)


@check(
    "ann_topk_wide",
    f"""WITH {CELLS_SQL},
wide AS (SELECT question_id, q, label AS cell FROM asked, centre
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY list_cosine_similarity(q, c) DESC) <= {WIDE}),
near AS (SELECT question_id, vec_id AS chunk_id, list_cosine_similarity(q, e) AS similarity FROM wide JOIN placed USING (cell)
  QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY round(similarity, 9) DESC, vec_id) <= 20)
SELECT question_id, chunk_id, round(n.similarity, 6) AS similarity, x.chunk_id IS NOT NULL AS exact
FROM near n LEFT JOIN exact x USING (question_id, chunk_id)""",
)
def ann_topk_wide(spark, folder):
    """The same from so many label cells that at least nine tenths of the exact
    neighbours are found."""
    return _probed(spark, folder, WIDE)


def _chunks_and_questions(spark, folder):
    vectors = table(spark, folder, "embeddings")
    asked = table(spark, folder, "benchmark").select("item_id").join(
        vectors, F.col("item_id") == F.col("vec_id")
    ).select(F.col("item_id").alias("question_id"), F.col("embedding").alias("vector"))
    return vectors.select(F.col("vec_id").alias("chunk_id"), "embedding", "label"), asked


def _beside_exact(found, chunks, asked):
    exact = search.vector_topk(chunks, asked, 20).select("question_id", "chunk_id", F.lit(True).alias("exact"))
    return found.join(exact, ["question_id", "chunk_id"], "left").select(
        "question_id", "chunk_id", F.round("similarity", 6).alias("similarity"),
        F.coalesce("exact", F.lit(False)).alias("exact"),
    )


def _probed(spark, folder, probes):
    chunks, asked = _chunks_and_questions(spark, folder)
    cells = ann.label_cells(chunks)
    placed = ann.write_cells(chunks, cells, shared_path(spark, "cells"))
    return _beside_exact(ann.ann_topk(placed, asked, cells, probes, 20), chunks, asked)
