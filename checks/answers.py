"""Screening, grounding, and the whole answer flow."""

from pyspark.sql import functions as F

from checks import check
from checks.catalogue import PRODUCTS, products_of
from checks.ingest import BLANK
from checks.retrieval import (
    NEAR,
    SCOPED_SQL,
    TO_ENGLISH,
    VECTOR_CHUNKS,
    rank_sql,
    stored_chunks,
)
from checks.threads import THREADS, messages_of, threads_of
from citeline import ports
from citeline.config import Settings
from citeline.functions import guard
from citeline.operators import answer, search
from citeline.plans import tools
from citeline.plans.ask import ask
from citeline.sources.tables import benchmark_questions, product_links, table


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


PATTERNS = " OR ".join(
    f"regexp_matches(t, {sql_text('(?i)' + p)})" for p in guard.INJECTION_PATTERNS
)


@check(
    "prescreen",
    f"""WITH question AS (
  SELECT 'document' AS kind, doc_id AS id, text AS q FROM documents
  UNION ALL SELECT 'item', item_id, text FROM benchmark
  UNION ALL SELECT 'event', event_id, props FROM events
  UNION ALL SELECT 'message', conv_id * 1000 + turn, role || ': ' || text FROM conversations
),
stripped AS (SELECT kind, id, regexp_replace(q, '^{BLANK}+|{BLANK}+$', '', 'g') AS t FROM question)
SELECT kind, id, CASE WHEN length(t) < 2 THEN 'too_short' WHEN length(t) > 2000 THEN 'too_long'
  WHEN length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) / length(t) < 0.4 THEN 'not_text'
  WHEN {PATTERNS} THEN 'injection' END AS reason
FROM stripped""",
)
def prescreen(spark, folder):
    def asked(name, kind, number, text):
        return table(spark, folder, name).select(
            F.lit(kind).alias("kind"), number.alias("id"), text.alias("q")
        )

    parts = [
        asked("documents", "document", F.col("doc_id"), F.col("text")),
        asked("benchmark", "item", F.col("item_id"), F.col("text")),
        asked("events", "event", F.col("event_id"), F.col("props")),
        asked(
            "conversations", "message", F.col("conv_id") * 1000 + F.col("turn"),
            F.concat_ws(": ", "role", "text"),
        ),
    ]
    questions = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    return questions.select("kind", "id", guard.prescreen(F.col("q")).alias("reason"))


@check(
    "grounding",
    f"""WITH {VECTOR_CHUNKS},
pairs AS (SELECT question_id, chunk_id, list_cosine_similarity(q.vec, c.vec) AS similarity
  FROM question_vectors q CROSS JOIN chunk_vectors c),
top AS ({rank_sql("pairs", NEAR, 5, 0)}),
given AS (SELECT question_id, list(chunk_id ORDER BY rank) AS ids FROM top GROUP BY 1),
cited AS (SELECT question_id, ids, CASE question_id % 4 WHEN 0 THEN [] WHEN 1 THEN ids[1:2]
  WHEN 2 THEN [ids[1], -1] ELSE [ids[1], ids[1], -1, -2] END AS c FROM given),
counted AS (SELECT question_id, len(list_distinct(c)) AS n,
  len(list_filter(list_distinct(c), lambda x: NOT list_contains(ids, x))) AS invented FROM cited)
SELECT question_id, n > 0 AND invented = 0 AS grounded, invented,
  CASE WHEN n = 0 THEN {sql_text(guard.NO_CITATION_FEEDBACK)} WHEN invented > 0 THEN 'You cited ' || invented ||
    ' chunk id(s) that were not in the extracts provided. Cite only ids you were given.' END AS feedback
FROM counted""",
)
def grounding(spark, folder):
    vectors = table(spark, folder, "embeddings")
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = table(spark, folder, "benchmark").select("item_id").join(
        vectors, F.col("item_id") == F.col("vec_id")
    ).select(F.col("item_id").alias("question_id"), F.col("embedding").alias("vector"))
    top = search.vector_topk(chunks, asked, 5)
    given = top.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "chunk_id")))["chunk_id"].cast("array<string>").alias("ids")
    )
    kind, ids = F.col("question_id") % 4, F.col("ids")
    none = F.array().cast("array<string>")
    cited = (
        F.when(kind == 0, none)
        .when(kind == 1, F.slice(ids, 1, 2))
        .when(kind == 2, F.array(ids[0], F.lit("-1")))
        .otherwise(F.array(ids[0], ids[0], F.lit("-1"), F.lit("-2")))
    )
    return given.select("question_id", guard.grounding(cited, ids).alias("g")).select(
        "question_id", "g.*"
    )


def by_length(question):
    """A router that sends a share of the questions down every branch."""
    kind = F.length(question) % 7
    return (
        F.when(kind == 0, "safety").when(kind == 1, "out_of_scope")
        .when(kind == 2, "small_talk").otherwise("how_to")
    )


def stubborn(hits, conversation, feedback, question):
    """A generator that invents a citation for some questions, and after the
    feedback corrects itself for half of them."""
    good = ports.quote_best(hits, feedback)
    text = good["answer"]
    invented = F.array(F.struct(F.lit("invented").alias("chunk_id"), F.lit(1).alias("page")))
    none = F.array().cast(answer.CITATIONS)
    first = feedback.isNull()
    cites = (
        F.when(first & (F.length(question) % 3 == 0), invented)
        .when(~first & (F.length(question) % 2 == 1), none)
        .otherwise(good["citations"])
    )
    return F.struct(text.alias("answer"), cites.alias("citations"))


STRICT = Settings(min_similarity=0.6)

FLOW = """,
best AS (SELECT h.*, c.page_from, c.content FROM hits h JOIN chunk c USING (chunk_id) WHERE rank = 1),
flow AS (
  SELECT q.question_id, q.question, q.product_id, length(question) AS n, b.chunk_id, b.page_from, b.content, b.similarity,
    CASE length(question) % 7 WHEN 0 THEN 'safety' WHEN 1 THEN 'out_of_scope' WHEN 2 THEN 'small_talk' ELSE 'how_to' END AS intent
  FROM question q LEFT JOIN best b USING (question_id)
),
state AS (
  SELECT *, CASE WHEN intent <> 'how_to' THEN intent WHEN coalesce(similarity, 0) < 0.6 THEN 'weak'
    WHEN n % 3 <> 0 THEN 'first' WHEN n % 2 = 0 THEN 'second' ELSE 'lost' END AS state FROM flow
)"""
FLOW_SQL = SCOPED_SQL + FLOW


REPLY = f"""CASE state WHEN 'safety' THEN {sql_text(guard.SAFETY_ANSWER)}
    WHEN 'out_of_scope' THEN {sql_text(guard.OUT_OF_SCOPE_ANSWER)}
    WHEN 'small_talk' THEN {sql_text(ports.GREETING)} WHEN 'weak' THEN {sql_text(guard.ESCALATION_ANSWER)}
    WHEN 'lost' THEN {sql_text(guard.ESCALATION_ANSWER)} ELSE content END"""


def chosen_ports():
    return answer.Ports(
        route=by_length, generate=stubborn, translate=ports.glossary(TO_ENGLISH)
    )


def flow(spark, folder):
    asked = benchmark_questions(spark, folder).select("question_id", "question", "product_id")
    return answer.answer_questions(
        asked, stored_chunks(spark, folder), product_links(spark, folder), chosen_ports(), STRICT
    )


@check(
    "answer_questions",
    f"""{FLOW_SQL}
SELECT question_id, intent, state IN ('first', 'second', 'safety', 'out_of_scope', 'small_talk') AS grounded,
  state IN ('weak', 'lost') AS escalated,
  CASE state WHEN 'first' THEN 1 WHEN 'second' THEN 2 WHEN 'lost' THEN 2 ELSE 0 END AS attempts,
  CASE WHEN state IN ('first', 'second') THEN chunk_id || ':' || page_from ELSE '' END AS cited,
  {REPLY} AS answer
FROM state""",
)
def answer_questions(spark, folder):
    pairs = F.transform("citations", lambda c: F.concat_ws(":", c["chunk_id"], c["page"]))
    return flow(spark, folder).select(
        "question_id", "intent", "grounded", "escalated", "attempts",
        F.concat_ws(",", pairs).alias("cited"), "answer",
    )


@check(
    "log_entries",
    f"""{FLOW_SQL}
SELECT question_id, replace(lower(regexp_replace(question, '^{BLANK}+|{BLANK}+$', '', 'g')), 'ß', 'ss') AS normalized_question,
  CASE WHEN intent <> 'small_talk' THEN intent END AS intent, state NOT IN ('weak', 'lost') AS resolved
FROM state""",
)
def log_entries(spark, folder):
    return answer.log_entries(flow(spark, folder)).select(
        "question_id", "normalized_question", "intent", "resolved"
    )


def requests_of(spark, folder):
    """Benchmark items as requests: by turns in a thread, by product, by token,
    and some that must be refused."""
    asked = benchmark_questions(spark, folder)
    number = F.col("question_id")
    none = F.lit(None)
    return asked.select(
        number.alias("request_id"),
        "question",
        F.when((number % 2 == 0) & (number % 8 != 0), F.col("product_id")).alias("product_id"),
        F.when(number % 8 == 0, F.concat(F.lit("token"), number % 16)).alias("product_token"),
        F.when(number % 2 == 1, number % 7).otherwise(none).alias("conversation_id"),
    )


# The same requests in SQL: token 8 is known, token 0 too; a thread brings its product.
ASK_SQL = (
    SCOPED_SQL.replace(
        "text AS question, label AS product_id",
        "text AS question, CASE WHEN item_id % 2 = 1 THEN (item_id % 7) % 10"
        " WHEN item_id % 8 = 0 THEN item_id % 16 ELSE label END AS product_id",
    )
    + FLOW
    + f""", {THREADS}, {PRODUCTS},
request AS (
  SELECT s.*, CASE WHEN question_id % 2 = 1 THEN question_id % 7 ELSE 1000000 + question_id END AS conversation_id,
    {REPLY} AS reply
  FROM state s
  WHERE question_id % 2 = 1 OR question_id % 8 <> 0 OR question_id % 16 IN (SELECT product_id FROM product)
),
last AS (SELECT conversation_id, max(ordinal) AS last FROM message GROUP BY 1),
placed AS (
  SELECT r.*, coalesce(last, -1) + 2 * row_number() OVER (PARTITION BY conversation_id ORDER BY question_id) - 1 AS o
  FROM request r LEFT JOIN last USING (conversation_id)
)"""
)


def asked(spark, folder):
    return ask(
        requests_of(spark, folder), products_of(spark, folder), threads_of(spark, folder),
        messages_of(spark, folder), stored_chunks(spark, folder), product_links(spark, folder),
        lambda request: request + 1_000_000, chosen_ports(),
        now=F.lit("2024-02-01").cast("timestamp"), s=STRICT,
    )


@check(
    "ask_responses",
    f"""{ASK_SQL}
SELECT question_id AS request_id, conversation_id, question, reply AS answer, intent,
  state IN ('first', 'second', 'safety', 'out_of_scope', 'small_talk') AS grounded, state IN ('weak', 'lost') AS escalated
FROM placed""",
)
def ask_responses(spark, folder):
    return asked(spark, folder)["responses"].select(
        "request_id", "conversation_id", "question", "answer", "intent", "grounded", "escalated"
    )


@check(
    "ask_log",
    f"""{ASK_SQL}
SELECT question_id, conversation_id,
  replace(lower(regexp_replace(question, '^{BLANK}+|{BLANK}+$', '', 'g')), 'ß', 'ss') AS normalized_question,
  CASE WHEN intent <> 'small_talk' THEN intent END AS intent, state NOT IN ('weak', 'lost') AS resolved
FROM placed""",
)
def ask_log(spark, folder):
    return asked(spark, folder)["query_log"].select(
        "question_id", "conversation_id", "normalized_question", "intent", "resolved"
    )


@check(
    "answers_of_failing_ports",
    f"""{FLOW_SQL}
SELECT question_id, question_id % 3 = 0 AS routed, true AS answered FROM state""",
)
def answers_of_failing_ports(spark, folder):
    """Router and translator fail on two questions of three: none is lost."""
    some = F.col("question_id") % 3 == 0
    broken = answer.Ports(
        route=lambda q: F.when(some, by_length(q)),
        translate=lambda q: F.when(some, q),
        generate=stubborn,
    )
    questions = benchmark_questions(spark, folder).select("question_id", "question", "product_id")
    out = answer.answer_questions(
        questions, stored_chunks(spark, folder), product_links(spark, folder), broken, STRICT
    )
    return out.select(
        "question_id", F.col("intent").isNotNull().alias("routed"), F.col("answer").isNotNull().alias("answered")
    )


@check(
    "ask_messages",
    f"""{ASK_SQL}
SELECT conversation_id, ordinal, role, content FROM message
UNION ALL SELECT conversation_id, o, 'user', question FROM placed
UNION ALL SELECT conversation_id, o + 1, 'assistant', reply FROM placed""",
)
def ask_messages(spark, folder):
    return asked(spark, folder)["messages"].select("conversation_id", "ordinal", "role", "content")


@check(
    "ask_threads",
    f"""{ASK_SQL},
everything AS (
  SELECT conversation_id, ordinal FROM message UNION ALL SELECT conversation_id, o FROM placed
  UNION ALL SELECT conversation_id, o + 1 FROM placed
),
total AS (SELECT conversation_id, count(*) AS total FROM everything GROUP BY 1),
state_after AS (
  SELECT conversation_id, product_id, summarised_through AS through FROM thread
  UNION ALL SELECT conversation_id, product_id, 0 FROM placed WHERE conversation_id >= 1000000
)
SELECT conversation_id, product_id, CASE WHEN total - through > 6 AND total - 6 > through THEN total - 6 ELSE through END
  AS summarised_through
FROM state_after LEFT JOIN total USING (conversation_id)""",
)
def ask_threads(spark, folder):
    return asked(spark, folder)["conversations"].select(
        "conversation_id", "product_id", "summarised_through"
    )


@check(
    "search_manual",
    f"""{SCOPED_SQL}
SELECT question_id, rank, chunk_id, content, page_from || '-' || page_to AS pages, language,
  round(round(similarity, 9), 3) AS similarity
FROM hits JOIN chunk USING (chunk_id)""",
)
def search_manual(spark, folder):
    names = products_of(spark, folder).select("product_id", F.upper("brand").alias("brand"), "model")
    queries = benchmark_questions(spark, folder).join(names, "product_id", "left").select(
        "question_id", "question", "brand", "model"
    )
    return tools.search_manual(
        queries, products_of(spark, folder), product_links(spark, folder),
        stored_chunks(spark, folder), chosen_ports(),
    )


@check(
    "ask_manual",
    f"""{FLOW_SQL}
SELECT question_id, {REPLY} AS answer, intent, state NOT IN ('weak', 'lost') AS grounded,
  state IN ('weak', 'lost') AS escalated FROM state""",
)
def ask_manual(spark, folder):
    names = products_of(spark, folder).select("product_id", F.upper("brand").alias("brand"), "model")
    queries = benchmark_questions(spark, folder).join(names, "product_id", "left").select(
        "question_id", "question", "brand", "model"
    )
    return tools.ask_manual(
        queries, products_of(spark, folder), product_links(spark, folder),
        stored_chunks(spark, folder), chosen_ports(), STRICT,
    ).drop("citations")
