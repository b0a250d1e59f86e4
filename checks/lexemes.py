"""Tokens with compounds, URLs, decimals and positions, and rankings by them."""

from pyspark.sql import functions as F

from checks import check
from checks.retrieval import NEAR, rank_sql
from citeline.functions import lexemes as lx
from citeline.operators import term_index
from citeline.session import shared_path
from citeline.sources.tables import benchmark_questions, document_texts, spread


def tokens_sql(text: str) -> str:
    """SQL for the list of tokens of a text."""
    return f"""flatten(list_transform(regexp_extract_all(lower({text}), '{lx.pattern("")}'), lambda t: CASE
      WHEN t LIKE '%://' THEN CAST([] AS VARCHAR[])
      WHEN contains(t, '@') THEN [t]
      WHEN contains(t, '/') THEN [t, substr(t, 1, instr(t, '/') - 1), substr(t, instr(t, '/'))]
      WHEN contains(t, '.') OR NOT contains(t, '-') OR t[1] IN ('+', '-') THEN [t]
      ELSE list_concat([t], string_split(t, '-')) END))"""


def vectors_sql(key: str, text: str, table: str) -> str:
    return f"""WITH cut AS (SELECT {key}, {tokens_sql(text)} AS toks FROM {table}),
each AS (SELECT {key}, unnest(toks) AS t, generate_subscripts(toks, 1) AS i FROM cut),
held AS (SELECT {key}, t, t || ':' || string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS shown FROM each GROUP BY {key}, t),
vectors AS (SELECT {key}, count(*) AS n, string_agg(shown, ' ' ORDER BY t) AS v FROM held GROUP BY {key})
SELECT c.{key}, CAST(coalesce(len(toks), 0) AS BIGINT) AS n_tokens, coalesce(n, 0) AS n_lexemes,
       md5(coalesce(v, '')) AS vector_md5
FROM cut c LEFT JOIN vectors USING ({key})"""


def vectors(rows, key, text):
    cut = rows.select(key, lx.lexemes(F.coalesce(text, F.lit(""))).alias("toks"))
    return cut.select(
        key,
        F.size("toks").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("toks")).cast("long").alias("n_lexemes"),
        F.md5(lx.vector(F.col("toks")).cast("binary")).alias("vector_md5"),
    )


@check("document_lexemes", vectors_sql("doc_id", "text", "documents"))
def document_lexemes(spark, folder):
    """Token vectors of whole documents."""
    return vectors(spread(spark, folder, "documents"), "doc_id", F.col("text"))


@check("page_lexemes", vectors_sql("page_id", "url || ' ' || html", "pages"))
def page_lexemes(spark, folder):
    """Token vectors of raw pages, which hold URLs, hosts and numbers."""
    return vectors(spread(spark, folder, "pages"), "page_id", F.concat("url", F.lit(" "), "html"))


@check(
    "lexeme_topk",
    f"""WITH cut AS (SELECT doc_id AS chunk_id, {tokens_sql("text")} AS toks FROM documents),
lengths AS (SELECT chunk_id, len(toks) AS n FROM cut),
corpus AS (SELECT count(*)::DOUBLE AS n, avg(n) AS mean FROM lengths),
postings AS (SELECT chunk_id, tok, count(*) AS tf FROM (SELECT chunk_id, unnest(toks) AS tok FROM cut) GROUP BY ALL),
dfs AS (SELECT tok, count(*)::DOUBLE AS df FROM postings GROUP BY tok),
asked AS (SELECT DISTINCT item_id AS question_id, unnest({tokens_sql("text")}) AS tok FROM benchmark),
scores AS (
  SELECT a.question_id, p.chunk_id,
         sum(ln(1 + (c.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.n / c.mean))) AS similarity
  FROM asked a JOIN postings p USING (tok) JOIN dfs USING (tok) JOIN lengths l USING (chunk_id), corpus c
  GROUP BY 1, 2
)
SELECT question_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(similarity, 6) AS score
FROM ({rank_sql("scores", NEAR, 20, 1)})""",
)
def lexeme_topk(spark, folder):
    """BM25 from a term index that was cut by these tokens."""
    index = term_index.write_index(
        document_texts(spark, folder), shared_path(spark, "lexemes"), cut=lx.lexemes, cut_question=lx.query_lexemes
    )
    asked = benchmark_questions(spark, folder).select("question_id", "question")
    found = term_index.ranked(index, asked, score=term_index.bm25)
    return found.select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))
