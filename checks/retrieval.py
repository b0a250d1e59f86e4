"""Retrieval queries: vector, lexical, fused, merged, scoped."""


from pyspark.sql import functions as F

from checks import check
from citeline import ports
from citeline.config import Settings
from citeline.functions import text as fx
from citeline.operators import search, term_index
from citeline.session import settle, shared_path
from citeline.sources.tables import (
    benchmark_questions,
    document_chunks,
    document_texts,
    product_links,
    spread,
    table,
)

# A word list that stands in for a translator into the pivot language.
TO_ENGLISH = {"le": "the", "la": "the", "der": "the", "die": "the", "und": "and"}

VECTOR_CHUNKS = """
chunk_vectors AS (
  SELECT vec_id AS chunk_id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings
),
question_vectors AS (
  SELECT item_id AS question_id, CAST(embedding AS DOUBLE[]) AS vec
  FROM benchmark JOIN embeddings ON vec_id = item_id
)"""


def hashed(name: str, source: str) -> str:
    """SQL for the hashing embedder: (id, i, x) triples of unit vectors."""
    return f"""
{name}_tokens AS (
  SELECT id, unnest(regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}_]+')) AS tok
  FROM {source}
),
{name}_sums AS (
  SELECT id, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 64 AS i,
         CAST(sum(CASE WHEN substr(md5(tok), 9, 1) < '8' THEN 1 ELSE -1 END) AS DOUBLE) AS v
  FROM {name}_tokens GROUP BY 1, 2
),
{name}_vec AS (
  SELECT id, i, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS x
  FROM {name}_sums WHERE v <> 0
),
{name}_norm AS (SELECT id, sqrt(sum(x * x)) AS norm FROM {name}_vec GROUP BY id)"""


CHUNK_SQL = """
docs AS (SELECT doc_id AS id, text AS txt FROM documents),
chunk AS (
  SELECT doc_id AS chunk_id, source || '-' || lang AS manual_id,
         doc_id % 50 + 1 AS page_from, doc_id % 50 + 1 + n_chars // 4000 AS page_to,
         lang AS language, text AS content, label,
         (n_chars % 2 = 1 AND label IS NOT NULL) AS only_own
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id
),
link AS (SELECT DISTINCT source || '-' || lang AS manual_id, label AS product_id
         FROM documents JOIN embeddings ON vec_id = doc_id),
asked AS (SELECT item_id AS id, text AS txt FROM benchmark),
question AS (
  SELECT item_id AS question_id, text AS question, label AS product_id
  FROM benchmark LEFT JOIN embeddings ON vec_id = item_id
)""" + "," + hashed("d", "docs") + "," + hashed("q", "asked") + """,
lexical_terms AS (
  SELECT DISTINCT item_id AS question_id,
         unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{L}\\p{N}_]+')) AS tok
  FROM benchmark
),
n_terms AS (SELECT question_id, count(*) AS n FROM lexical_terms GROUP BY 1),
postings AS (SELECT id AS chunk_id, tok, count(*) AS tf FROM d_tokens GROUP BY 1, 2),
lexical_scores AS (
  SELECT t.question_id, p.chunk_id,
         sum(list_sum(list_transform(range(1, p.tf + 1), lambda i: 1.0 / (i * i)))) / any_value(n.n) AS score
  FROM lexical_terms t JOIN postings p USING (tok) JOIN n_terms n USING (question_id)
  GROUP BY 1, 2
),
cosine AS (
  SELECT q.id AS question_id, d.id AS chunk_id,
         sum(q.x * d.x) / any_value(qn.norm * dn.norm) AS similarity
  FROM q_vec q JOIN d_vec d USING (i)
  JOIN q_norm qn ON qn.id = q.id JOIN d_norm dn ON dn.id = d.id
  GROUP BY 1, 2
),
all_pairs AS (
  SELECT q.id AS question_id, d.id AS chunk_id, coalesce(c.similarity, 0) AS similarity
  FROM q_norm q CROSS JOIN d_norm d
  LEFT JOIN cosine c ON c.question_id = q.id AND c.chunk_id = d.id
)"""

TRANSLATION_SQL = """
said AS (SELECT item_id AS id, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
translated AS (
  SELECT id, text AS original, CASE WHEN list_has_any(w, ['le', 'la', 'der', 'die', 'und']) THEN
    array_to_string(list_transform(w, lambda t: CASE WHEN t IN ('le', 'la', 'der', 'die') THEN 'the'
      WHEN t = 'und' THEN 'and' ELSE t END), ' ') ELSE text END AS txt
  FROM said
),
asked2 AS (SELECT id, txt FROM translated WHERE lower(txt) <> lower(original))
""" + "," + hashed("t", "asked2") + """,
cosine2 AS (
  SELECT q.id AS question_id, d.id AS chunk_id,
         sum(q.x * d.x) / any_value(qn.norm * dn.norm) AS similarity
  FROM t_vec q JOIN d_vec d USING (i)
  JOIN t_norm qn ON qn.id = q.id JOIN d_norm dn ON dn.id = d.id
  GROUP BY 1, 2
),
all_pairs2 AS (
  SELECT q.id AS question_id, d.id AS chunk_id, coalesce(c.similarity, 0) AS similarity
  FROM t_norm q CROSS JOIN d_norm d
  LEFT JOIN cosine2 c ON c.question_id = q.id AND c.chunk_id = d.id
)"""


def rank_sql(source: str, order: str, k: int, idx: int, extra: str = "") -> str:
    return f"""
  SELECT {idx} AS list_idx, question_id, chunk_id, similarity, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {order}, chunk_id) AS rank
    FROM {source} {extra})
  WHERE rank <= {k}"""


NEAR = "round(similarity, 9) DESC"
FUSED_SQL = """
fused AS (
  SELECT question_id, chunk_id,
    coalesce(max(CASE WHEN list_idx = 0 THEN 1.0::DOUBLE / (60 + rank) END), 0)
    + coalesce(max(CASE WHEN list_idx = 1 THEN 1.0::DOUBLE / (60 + rank) END), 0)
    + coalesce(max(CASE WHEN list_idx = 2 THEN 1.0::DOUBLE / (60 + rank) END), 0) AS score,
    max(similarity) AS similarity, min(list_idx * 1000 + rank) AS seen
  FROM candidates GROUP BY 1, 2
),
hits AS (
  SELECT question_id, rank, chunk_id, score, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seen) AS rank FROM fused)
  WHERE rank <= 5
)"""

SCOPED_JOIN = """
  JOIN question qq USING (question_id) JOIN chunk cc USING (chunk_id)
  WHERE qq.product_id IS NULL OR (
    EXISTS (SELECT 1 FROM link l WHERE l.manual_id = cc.manual_id AND l.product_id = qq.product_id)
    AND (NOT cc.only_own OR cc.label = qq.product_id))"""

HYBRID_SQL = f"""WITH {CHUNK_SQL}, {TRANSLATION_SQL},
lexical_pairs AS (SELECT * FROM lexical_scores JOIN all_pairs USING (question_id, chunk_id)),
candidates AS ({rank_sql("all_pairs", NEAR, 20, 0)}
  UNION ALL {rank_sql("lexical_pairs", "round(score, 9) DESC", 20, 1)}
  UNION ALL {rank_sql("all_pairs2", NEAR, 20, 2)}
), {FUSED_SQL}"""

SCOPED_SQL = f"""WITH {CHUNK_SQL}, {TRANSLATION_SQL},
scoped AS (SELECT question_id, chunk_id, similarity FROM all_pairs {SCOPED_JOIN}),
scoped2 AS (SELECT question_id, chunk_id, similarity FROM all_pairs2 {SCOPED_JOIN}),
lexical_pairs AS (SELECT * FROM lexical_scores JOIN scoped USING (question_id, chunk_id)),
candidates AS ({rank_sql("scoped", NEAR, 20, 0)}
  UNION ALL {rank_sql("lexical_pairs", "round(score, 9) DESC", 20, 1)}
  UNION ALL {rank_sql("scoped2", NEAR, 20, 2)}
), {FUSED_SQL}"""


def embedded_chunks(spark, folder):
    return ports.embed(document_chunks(spark, folder), "content")


def stored_chunks(spark, folder):
    """The chunk table as ingestion leaves it: vectors computed once."""
    return settle(embedded_chunks(spark, folder))


def embedded_questions(spark, folder):
    """Questions with their vector, terms, translation and its vector."""
    asked = benchmark_questions(spark, folder)
    translated = ports.glossary(TO_ENGLISH)(F.col("question"))
    asked = asked.withColumn(
        "translated", fx.distinct_translation(translated, F.col("question"))
    )
    asked = ports.embed(asked, "question", "vector")
    asked = ports.embed(asked, "translated", "translated_vector")
    return asked.withColumn(
        "translated_vector",
        F.when(F.col("translated").isNotNull(), F.col("translated_vector")),
    )


@check(
    "vector_topk",
    f"""WITH {VECTOR_CHUNKS},
pairs AS (
  SELECT question_id, chunk_id, list_cosine_similarity(q.vec, c.vec) AS similarity
  FROM question_vectors q CROSS JOIN chunk_vectors c
)
SELECT question_id, chunk_id, rank, round(similarity, 6) AS similarity
FROM ({rank_sql("pairs", NEAR, 20, 0)})""",
)
def vector_topk(spark, folder):
    vectors = table(spark, folder, "embeddings")
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = table(spark, folder, "benchmark").select("item_id").join(
        vectors, F.col("item_id") == F.col("vec_id")
    )
    asked = asked.select(F.col("item_id").alias("question_id"), F.col("embedding").alias("vector"))
    return search.vector_topk(chunks, asked).select(
        "question_id", "chunk_id", "rank", F.round("similarity", 6).alias("similarity")
    )


@check(
    "lexical_topk",
    f"""WITH {CHUNK_SQL}
SELECT question_id, chunk_id, rank, round(similarity, 6) AS score FROM ({rank_sql(
  "(SELECT question_id, chunk_id, score AS similarity FROM lexical_scores)", NEAR, 20, 1)})""",
)
def lexical_topk(spark, folder):
    asked = benchmark_questions(spark, folder).drop("product_id")
    chunks = document_chunks(spark, folder)
    return search.lexical_topk(chunks, asked).select(
        "question_id", "chunk_id", "rank", F.round("score", 6).alias("score")
    )


INDEXED_SQL = f"""WITH {CHUNK_SQL}
SELECT question_id, chunk_id, rank, round(similarity, 6) AS score FROM ({rank_sql(
  "(SELECT question_id, chunk_id, score AS similarity FROM lexical_scores)", NEAR, 20, 1)})"""


def term_index_of(spark, folder):
    path = shared_path(spark, "terms")
    return term_index.write_index(document_texts(spark, folder), path)


@check("indexed_topk", INDEXED_SQL)
def indexed_topk(spark, folder):
    """The ranking of ``lexical_topk``, from the term index."""
    asked = benchmark_questions(spark, folder).select("question_id", "question")
    found = term_index.ranked(term_index_of(spark, folder), asked)
    return found.select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@check(
    "bm25_topk",
    f"""WITH {CHUNK_SQL},
lengths AS (SELECT id AS chunk_id, len(regexp_extract_all(lower(txt), '[\\p{{L}}\\p{{N}}_]+')) AS n FROM docs),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(n) AS mean FROM lengths),
dfs AS (SELECT tok, count(*)::DOUBLE AS df FROM postings GROUP BY tok),
scores AS (
  SELECT t.question_id, p.chunk_id,
         sum(ln(1 + (c.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.n / c.mean))) AS similarity
  FROM lexical_terms t JOIN postings p USING (tok) JOIN dfs USING (tok) JOIN lengths l USING (chunk_id), corpus c
  GROUP BY 1, 2
)
SELECT question_id, chunk_id, rank, round(similarity, 6) AS score FROM ({rank_sql("scores", NEAR, 20, 1)})""",
)
def bm25_topk(spark, folder):
    """BM25 from the term index."""
    asked = benchmark_questions(spark, folder).select("question_id", "question")
    found = term_index.ranked(term_index_of(spark, folder), asked, score=term_index.bm25)
    return found.select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@check(
    "embed_texts",
    f"""WITH docs AS (SELECT doc_id AS id, text AS txt FROM documents), {hashed("d", "docs")}
SELECT id AS doc_id, i AS place, round(x, 6) AS value FROM d_vec""",
)
def embed_texts(spark, folder):
    docs = ports.embed(spread(spark, folder, "documents").select("doc_id", "text"), "text")
    return (
        docs.select("doc_id", F.posexplode("embedding").alias("place", "value"))
        .where("value <> 0")
        .select("doc_id", F.col("place").cast("long").alias("place"),
                F.round(F.col("value").cast("double"), 6).alias("value"))
    )


@check(
    "hybrid_rrf",
    f"""{HYBRID_SQL}
SELECT question_id, rank, chunk_id, round(score, 9) AS score, round(similarity, 6) AS similarity
FROM hits""",
)
def hybrid_rrf(spark, folder):
    hits = search.hybrid_search(
        embedded_chunks(spark, folder), embedded_questions(spark, folder).drop("product_id")
    )
    return hits.select(
        "question_id", "rank", "chunk_id",
        F.round("score", 9).alias("score"), F.round("similarity", 6).alias("similarity"),
    )


@check(
    "hybrid_blocks",
    f"""{HYBRID_SQL}
SELECT question_id, rank, chunk_id, round(score, 9) AS score, round(similarity, 6) AS similarity
FROM hits""",
)
def hybrid_blocks(spark, folder):
    """The same with the questions in blocks of at most twenty."""
    hits = search.hybrid_search(
        embedded_chunks(spark, folder), embedded_questions(spark, folder).drop("product_id"),
        s=Settings(question_block_rows=20),
    )
    return hits.select(
        "question_id", "rank", "chunk_id",
        F.round("score", 9).alias("score"), F.round("similarity", 6).alias("similarity"),
    )


@check(
    "scoped_search",
    f"""{SCOPED_SQL}
SELECT question_id, rank, chunk_id, manual_id, page_from, page_to, language, content,
       round(similarity, 6) AS similarity
FROM hits JOIN chunk USING (chunk_id)""",
)
def scoped_search(spark, folder):
    chunks = embedded_chunks(spark, folder)
    hits = search.hybrid_search(
        chunks, embedded_questions(spark, folder), product_links(spark, folder)
    )
    return search.fetch_hits(hits, chunks).select(
        "question_id", "rank", "chunk_id", "manual_id", "page_from", "page_to", "language",
        "content", F.round("similarity", 6).alias("similarity"),
    )


@check(
    "merge_semantic",
    f"""WITH {CHUNK_SQL}, {TRANSLATION_SQL},
candidates AS ({rank_sql("all_pairs", NEAR, 20, 0)}
  UNION ALL {rank_sql("all_pairs2", NEAR, 20, 2)}),
merged AS (SELECT question_id, chunk_id, max(similarity) AS similarity, min(list_idx * 1000 + rank) AS seen
  FROM candidates GROUP BY 1, 2)
SELECT question_id, rank, chunk_id, round(similarity, 6) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {NEAR}, seen) AS rank FROM merged)
WHERE rank <= 5""",
)
def merge_semantic(spark, folder):
    hits = search.semantic_search(embedded_chunks(spark, folder), embedded_questions(spark, folder))
    return hits.select(
        "question_id", "rank", "chunk_id", F.round("similarity", 6).alias("similarity")
    )


@check(
    "context_text",
    f"""{HYBRID_SQL}
SELECT question_id, string_agg('[chunk ' || chunk_id || ' · ' ||
  CASE WHEN page_from = page_to THEN 'page ' || page_from ELSE 'pages ' || page_from || '-' || page_to END
  || ']' || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context
FROM hits JOIN chunk USING (chunk_id) GROUP BY question_id""",
)
def context_text(spark, folder):
    chunks = embedded_chunks(spark, folder)
    asked = embedded_questions(spark, folder).drop("product_id")
    hits = search.hybrid_search(chunks, asked)
    return search.context_text(search.fetch_hits(hits, chunks))


@check(
    "product_scope",
    f"""WITH link AS (SELECT DISTINCT source || '-' || lang AS manual_id FROM documents
  JOIN embeddings ON vec_id = doc_id WHERE label = 3)
SELECT d.doc_id AS chunk_id, source || '-' || lang AS manual_id
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
WHERE source || '-' || lang IN (SELECT manual_id FROM link)
  AND (n_chars % 2 = 0 OR label IS NULL OR label = 3)""",
)
def product_scope(spark, folder):
    chunks = document_chunks(spark, folder)
    return search.scope_to_product(chunks, product_links(spark, folder), 3).select(
        "chunk_id", "manual_id"
    )
