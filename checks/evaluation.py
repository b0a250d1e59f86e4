"""Evaluation: cases, sources, graded results, summaries, comparisons."""


from pyspark.sql import functions as F

from checks import check
from checks.catalogue import PRODUCTS, products_of
from checks.retrieval import CHUNK_SQL, SCOPED_SQL, TO_ENGLISH, stored_chunks
from citeline import ports
from citeline.functions import text as fx
from citeline.operators import answer, evals
from citeline.plans import evaluate
from citeline.session import settle, shared_path
from citeline.sources.evaluation import compare_with_last, read_summaries, write_report
from citeline.sources.tables import (
    benchmark_questions,
    document_chunks,
    product_links,
    table,
)

TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


def cases_of(spark, folder):
    """Benchmark items as cases about the product of their vector."""
    number = F.col("question_id")
    asked = benchmark_questions(spark, folder).where("product_id IS NOT NULL")
    names = products_of(spark, folder).select("product_id", "brand", "model")
    pages = F.array((number % 50 + 1).cast("int"), (number % 50 + 3).cast("int"))
    return asked.join(names, "product_id").select(
        number.alias("id"),
        "question",
        F.upper("brand").alias("brand"),
        F.lower("model").alias("model"),
        F.lit("how_to").alias("intent"),
        (number % 4 != 3).alias("answerable"),
        F.when((number % 4 != 3) & (number % 5 != 0), pages)
        .otherwise(F.array().cast("array<int>")).alias("expected_pages"),
        F.col("question").alias("expected_answer"),
        F.slice(fx.tokens(F.col("question")), 1, 4).alias("key_facts"),
    )


CASES = f"""
eval_case AS (
  SELECT question_id AS id, question, product_id, upper(p.brand) AS brand, lower(p.model) AS model,
    question_id % 4 <> 3 AS answerable,
    CASE WHEN question_id % 4 <> 3 AND question_id % 5 <> 0
      THEN [question_id % 50 + 1, question_id % 50 + 3] ELSE [] END AS expected_pages,
    {TOKENS.format("question")}[1:4] AS key_facts
  FROM question JOIN product p USING (product_id)
)"""


@check(
    "resolve_products",
    f"""WITH {PRODUCTS}, question AS (SELECT item_id AS question_id, text AS question, label AS product_id
  FROM benchmark JOIN embeddings ON vec_id = item_id), {CASES} SELECT id, brand, model, product_id FROM eval_case""",
)
def resolve_products(spark, folder):
    return evals.resolve_products(cases_of(spark, folder), products_of(spark, folder)).select(
        "id", "brand", "model", "product_id"
    )


SOURCE = """
cited_page AS (SELECT h.question_id AS id, c.page_from AS page FROM hits h JOIN chunk c USING (chunk_id)
  WHERE h.rank = 1 AND h.similarity >= 0.35),
wanted AS (
  SELECT id, unnest(expected_pages) AS page FROM eval_case WHERE answerable
  UNION SELECT id, page FROM cited_page JOIN eval_case USING (id) WHERE answerable
),
source AS (
  SELECT w.id, left(string_agg('[page ' || c.page_from || ']' || chr(10) || c.content, chr(10) || chr(10)
    ORDER BY c.chunk_id), 6000) AS source
  FROM wanted w JOIN eval_case e USING (id) JOIN chunk c ON c.page_from = w.page
  WHERE EXISTS (SELECT 1 FROM link l WHERE l.manual_id = c.manual_id AND l.product_id = e.product_id)
    AND (NOT c.only_own OR c.label = e.product_id)
  GROUP BY w.id
)"""

RESULTS_SQL = f"""{SCOPED_SQL}, {PRODUCTS}, {CASES}, {SOURCE},
pages_hit AS (SELECT h.question_id AS id, list(DISTINCT p) AS pages FROM hits h JOIN chunk c USING (chunk_id),
  unnest(range(c.page_from, c.page_to + 1)) AS t(p) GROUP BY 1),
top AS (SELECT h.question_id AS id, h.similarity, c.content, c.page_from FROM hits h JOIN chunk c USING (chunk_id) WHERE rank = 1),
answered AS (
  SELECT e.*, t.similarity, coalesce(t.similarity, 0) < 0.35 AS escalated,
    CASE WHEN coalesce(t.similarity, 0) < 0.35 THEN
      'I could not find a reliable answer to this in the manual. Passing it to the manufacturer''s support team.'
      ELSE t.content END AS answer,
    coalesce(s.source, '') AS source, list_sort(coalesce(p.pages, [])) AS pages_retrieved
  FROM eval_case e LEFT JOIN top t USING (id) LEFT JOIN source s USING (id) LEFT JOIN pages_hit p USING (id)
),
judged AS (
  SELECT *, list_distinct({TOKENS.format("answer")}) AS said, list_distinct({TOKENS.format("question")}) AS wanted_words,
    list_distinct({TOKENS.format("question")} || {TOKENS.format("source")}) AS known_words
  FROM answered
),
result AS (
  SELECT *,
    CASE WHEN answerable THEN len(list_intersect(said, wanted_words)) * 2 >= len(wanted_words) ELSE escalated END AS covers,
    CASE WHEN answerable THEN len(list_intersect(said, known_words)) * 2 < len(said) ELSE NOT escalated END AS invents,
    CASE WHEN len(expected_pages) > 0 THEN list_has_any(expected_pages, pages_retrieved) END AS recall
  FROM judged
)"""


def results_of(spark, folder):
    flow = answer.Ports(route=lambda q: F.lit("how_to"), translate=ports.glossary(TO_ENGLISH))
    return evaluate.run_cases(
        cases_of(spark, folder), products_of(spark, folder), document_chunks(spark, folder),
        product_links(spark, folder), flow, embedded=stored_chunks(spark, folder),
    )


@check(
    "eval_results",
    f"""{RESULTS_SQL}
SELECT id, brand || ' ' || model AS product, answerable, recall, covers AND NOT invents AS correct, covers, invents,
  escalated, NOT escalated AS grounded, CASE WHEN escalated THEN 0 ELSE 1 END AS attempts,
  len(list_filter(key_facts, lambda f: contains(lower(answer), f))) || '/' || len(key_facts) AS key_facts_found,
  array_to_string(pages_retrieved, ',') AS pages_retrieved
FROM result""",
)
def eval_results(spark, folder):
    return results_of(spark, folder).select(
        "id", "product", "answerable", "recall", "correct", "covers", "invents", "escalated",
        "grounded", "attempts", "key_facts_found",
        F.concat_ws(",", F.col("pages_retrieved").cast("array<string>")).alias("pages_retrieved"),
    )


@check("source_texts", f"{SCOPED_SQL}, {PRODUCTS}, {CASES}, wanted AS (SELECT id, unnest(expected_pages) AS page FROM eval_case), "
    + """source AS (
  SELECT w.id, left(string_agg('[page ' || c.page_from || ']' || chr(10) || c.content, chr(10) || chr(10)
    ORDER BY c.chunk_id), 6000) AS source
  FROM wanted w JOIN eval_case e USING (id) JOIN chunk c ON c.page_from = w.page
  WHERE EXISTS (SELECT 1 FROM link l WHERE l.manual_id = c.manual_id AND l.product_id = e.product_id)
    AND (NOT c.only_own OR c.label = e.product_id)
  GROUP BY w.id
) SELECT id, source FROM source""")
def source_texts(spark, folder):
    cases = evals.resolve_products(cases_of(spark, folder), products_of(spark, folder))
    wanted = cases.select("id", "product_id", F.col("expected_pages").cast("array<bigint>").alias("pages"))
    return evals.source_texts(wanted, document_chunks(spark, folder), product_links(spark, folder))


@check("page_overlaps", f"""WITH {CHUNK_SQL},
wanted AS (
  SELECT question_id AS id, manual_id, question_id % 50 + 1 AS page_from, question_id % 50 + 1 + question_id % 11 AS page_to
  FROM question JOIN link USING (product_id))
SELECT id, w.manual_id, chunk_id, greatest(w.page_from, c.page_from) AS first, least(w.page_to, c.page_to) AS last
FROM wanted w JOIN chunk c ON c.manual_id = w.manual_id AND c.page_from <= w.page_to AND w.page_from <= c.page_to""")
def page_overlaps(spark, folder):
    """Chunks that meet a range of pages of any manual about a question's product."""
    number = F.col("question_id")
    asked = benchmark_questions(spark, folder).join(product_links(spark, folder), "product_id")
    wanted = asked.select(
        number.alias("id"), "manual_id", (number % 50 + 1).alias("page_from"),
        (number % 50 + 1 + number % 11).alias("page_to"),
    )
    return evals.page_overlaps(wanted, document_chunks(spark, folder))


def graded_labels(spark, folder):
    """Labels as graded cases: quality is coverage, toxicity invention."""
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    number = F.col("doc_id")
    covers, invents = F.col("quality") == 1, F.col("toxic") == 1
    return rows.select(
        number.alias("id"),
        (number % 5 != 0).alias("answerable"),
        F.when(number % 3 != 0, number % 7 != 0).alias("recall"),
        covers.alias("covers"), invents.alias("invents"), (covers & ~invents).alias("correct"),
        (number % 11 == 0).alias("escalated"),
        F.col("n_chars").cast("int").alias("latency_ms"),
        F.col("text").alias("judge_reason"),
    )


GRADED = """
graded AS (
  SELECT doc_id AS id, doc_id % 5 <> 0 AS answerable, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 7 <> 0 END AS recall,
    quality = 1 AS covers, toxic = 1 AS invents, quality = 1 AND toxic = 0 AS correct,
    doc_id % 11 = 0 AS escalated, n_chars AS latency_ms, text AS judge_reason
  FROM labels JOIN documents USING (doc_id)
)"""


def summary_sql(correct: str) -> str:
    return f"""SELECT count(*) AS cases, count(*) FILTER (answerable) AS answerable,
  count(*) FILTER (NOT answerable) AS unanswerable,
  round(avg(recall::INT) FILTER (answerable AND recall IS NOT NULL), 3) AS recall,
  round(avg(({correct})::INT) FILTER (answerable), 3) AS correctness,
  round(avg(covers::INT) FILTER (answerable), 3) AS coverage,
  round(avg(invents::INT) FILTER (answerable), 3) AS invention_rate,
  round(avg(({correct})::INT) FILTER (NOT answerable), 3) AS abstention,
  round(avg(escalated::INT) FILTER (answerable), 3) AS escalation_rate,
  list_sort(list(latency_ms))[count(*) // 2 + 1] AS median_latency_ms
FROM graded"""


@check("eval_summary", f"WITH {GRADED} {summary_sql('correct')}")
def eval_summary(spark, folder):
    return evals.summarise(graded_labels(spark, folder))


def measures_sql(rows: str, latency: str) -> str:
    return summary_sql("covers AND NOT invents").replace("FROM graded", f"FROM {rows}").replace(
        "list_sort(list(latency_ms))[count(*) // 2 + 1]", latency
    )


@check(
    "eval_run_summary",
    f"{RESULTS_SQL} {measures_sql('result', 'list_sort(list(length(answer)))[count(*) // 2 + 1]')}",
)
def eval_run_summary(spark, folder):
    """A whole run: cases through the flow, graded, measured. The length of an
    answer stands in for the time it took."""
    graded = results_of(spark, folder).withColumn("latency_ms", F.length("answer"))
    return evals.summarise(graded)


MEASURES = ", ".join(evals.METRICS)


@check(
    "run_delta",
    f"""WITH {GRADED}, now AS ({summary_sql("correct")}), old AS ({summary_sql("covers")}),
a AS (UNPIVOT (SELECT {MEASURES} FROM now) ON {MEASURES} INTO NAME metric VALUE value),
b AS (UNPIVOT (SELECT {MEASURES} FROM old) ON {MEASURES} INTO NAME metric VALUE before)
SELECT metric, value, before, round(value - before, 9) AS change FROM a LEFT JOIN b USING (metric)""",
)
def run_delta(spark, folder):
    graded = graded_labels(spark, folder)
    now = evals.summarise(graded)
    old = evals.summarise(graded.withColumn("correct", F.col("covers")))
    return evals.compare_runs(now, old).withColumn("change", F.round("change", 9))


@check(
    "report_delta",
    f"""WITH {GRADED}, now AS ({summary_sql("correct")}), old AS ({summary_sql("covers")}),
a AS (UNPIVOT (SELECT {MEASURES} FROM now) ON {MEASURES} INTO NAME metric VALUE value),
b AS (UNPIVOT (SELECT {MEASURES} FROM old) ON {MEASURES} INTO NAME metric VALUE before)
SELECT metric, value, before, round(value - before, 9) AS change FROM a LEFT JOIN b USING (metric)""",
)
def report_delta(spark, folder):
    """The same over reports that were written, one of them twice, and read."""
    graded = graded_labels(spark, folder)
    kept = shared_path(spark, "reports")
    now = evals.summarise(graded)
    old = evals.summarise(graded.withColumn("correct", F.col("covers")))
    for at, summary in (("2024-01-01T00:00", now), ("2024-01-02T00:00", old), ("2024-01-02T00:00", old)):
        write_report(summary, graded.limit(0), at, {}, kept)
    return compare_with_last(now, read_summaries(spark, kept)).withColumn("change", F.round("change", 9))


@check(
    "judge_consistency",
    f"{RESULTS_SQL} SELECT count(*) AS cases, CAST(0 AS BIGINT) AS unstable, 1.0::DOUBLE AS stability FROM result",
)
def judge_consistency(spark, folder):
    """Stored answers graded three times by a judge that does not waver."""
    stored = settle(results_of(spark, folder).select("id", "answer", "cited_pages"))
    overall, _ = evaluate.judge_consistency(
        stored, cases_of(spark, folder), products_of(spark, folder), document_chunks(spark, folder),
        product_links(spark, folder),
    )
    return overall


@check(
    "eval_failures",
    f"""WITH {GRADED} SELECT id, CASE WHEN recall = false THEN 'no-recall' ELSE '' END AS flag,
  left(judge_reason, 58) AS reason FROM graded WHERE NOT correct""",
)
def eval_failures(spark, folder):
    return evals.failures(graded_labels(spark, folder))


VERDICTS = """
verdict AS (
  SELECT doc_id AS id, 1 AS round, quality = 1 AS matches FROM labels
  UNION ALL SELECT doc_id, 2, toxic = 0 FROM labels
  UNION ALL SELECT doc_id, 3, quality = 1 FROM labels
),
split AS (SELECT id, count(*) FILTER (matches) AS passed, count(*) FILTER (NOT matches) AS failed FROM verdict GROUP BY id)"""


def verdicts_of(spark, folder):
    labels = table(spark, folder, "labels")
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    rounds = F.posexplode(F.array(good, clean, good)).alias("round", "matches")
    return labels.select(F.col("doc_id").alias("id"), rounds)


@check(
    "judge_stability",
    f"""WITH {VERDICTS} SELECT count(*) AS cases, count(*) FILTER (passed > 0 AND failed > 0) AS unstable,
  round(1 - count(*) FILTER (passed > 0 AND failed > 0) / count(*), 3) AS stability FROM split""",
)
def judge_stability(spark, folder):
    return evals.consistency(verdicts_of(spark, folder))[0]


@check(
    "unstable_cases",
    f"WITH {VERDICTS} SELECT * FROM split WHERE passed > 0 AND failed > 0",
)
def unstable_cases(spark, folder):
    return evals.consistency(verdicts_of(spark, folder))[1]


@check(
    "case_shapes",
    f"""WITH {GRADED} SELECT id, CASE WHEN answerable AND covers = false THEN 'an answerable case needs expected_answer'
  WHEN NOT answerable AND escalated THEN 'unanswerable cases cannot expect pages' END AS violation FROM graded""",
)
def case_shapes(spark, folder):
    shaped = graded_labels(spark, folder).select(
        "id", "answerable",
        F.when(F.col("covers"), "yes").alias("expected_answer"),
        F.when(F.col("escalated"), F.array(F.lit(1))).alias("expected_pages"),
    )
    return shaped.select("id", evals.case_violation().alias("violation"))
