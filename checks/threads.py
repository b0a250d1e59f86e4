"""Conversation queries: last messages, turns, lists, ranges of the notes."""

from pyspark.sql import functions as F

from checks import check
from checks.catalogue import PRODUCTS, products_of
from citeline import ports
from citeline.config import Settings
from citeline.operators import conversation, ordered
from citeline.sources.tables import table

START = "2024-01-01 00:00:00"


def messages_of(spark, folder):
    rows = table(spark, folder, "conversations")
    at = F.lit(START).cast("timestamp") + F.make_dt_interval(
        hours=(F.col("conv_id") % 97).cast("int"), mins=F.col("turn").cast("int")
    )
    return rows.select(
        F.col("conv_id").alias("conversation_id"), F.col("turn").alias("ordinal"), "role",
        F.col("text").alias("content"), at.alias("created_at"),
    )


def threads_of(spark, folder):
    """One thread per conversation, and an empty one per benchmark item."""
    known = table(spark, folder, "conversations").select("conv_id").distinct()
    empty = table(spark, folder, "benchmark").select((-1 - F.col("item_id")).alias("conv_id"))
    return known.union(empty).select(
        F.col("conv_id").alias("conversation_id"),
        F.pmod("conv_id", F.lit(10)).alias("product_id"),
        (F.lit(START).cast("timestamp")
         + F.make_dt_interval(hours=F.pmod("conv_id", F.lit(50)).cast("int"))).alias("created_at"),
        F.when(F.col("conv_id") % 2 == 0, "kept title").alias("title"),
        F.pmod("conv_id", F.lit(3)).alias("summarised_through"),
        F.lit(None).cast("struct<goal:string,tried:array<string>,outcome:string,facts:array<string>>").alias("summary"),
    )


THREADS = """
message AS (
  SELECT conv_id AS conversation_id, turn AS ordinal, role, text AS content,
    TIMESTAMP '2024-01-01' + to_hours(conv_id % 97) + to_minutes(turn) AS created_at FROM conversations
),
thread AS (
  SELECT conv_id AS conversation_id, (conv_id % 10 + 10) % 10 AS product_id,
    TIMESTAMP '2024-01-01' + to_hours((conv_id % 50 + 50) % 50) AS created_at,
    CASE WHEN conv_id % 2 = 0 THEN 'kept title' END AS title, (conv_id % 3 + 3) % 3 AS summarised_through
  FROM (SELECT DISTINCT conv_id FROM conversations UNION ALL SELECT -1 - item_id FROM benchmark)
)"""
TITLE = """CASE WHEN length({0}) <= 80 THEN {0} ELSE rtrim(left({0}, 79), ' ') || '…' END"""
FLAT = "trim(regexp_replace({0}, '[\\t-\\r\\x1c-\\x20]+', ' ', 'g'))"


@check(
    "recent_messages",
    f"""WITH {THREADS}
SELECT conversation_id, ordinal, role, content FROM (SELECT *, row_number() OVER (
  PARTITION BY conversation_id ORDER BY ordinal DESC) AS n FROM message) WHERE n <= 6""",
)
def recent_messages(spark, folder):
    return conversation.recent_messages(messages_of(spark, folder)).drop("created_at")


@check(
    "recent_history",
    f"""WITH {THREADS}
SELECT conversation_id, string_agg(role || ': ' || content, chr(10) ORDER BY ordinal) AS history
FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY ordinal DESC) AS n FROM message)
WHERE n <= 6 GROUP BY 1""",
)
def recent_history(spark, folder):
    return conversation.history(messages_of(spark, folder))


@check(
    "thread_list",
    f"""WITH {THREADS}
SELECT t.conversation_id, t.product_id, count(m.ordinal) AS messages,
  strftime(max(m.created_at), '%Y-%m-%d %H:%M:%S') AS last_message_at
FROM thread t LEFT JOIN message m USING (conversation_id) GROUP BY 1, 2""",
)
def thread_list(spark, folder):
    listed = conversation.list_threads(threads_of(spark, folder), messages_of(spark, folder))
    return listed.select(
        "conversation_id", "product_id", "messages",
        F.date_format("last_message_at", "yyyy-MM-dd HH:mm:ss").alias("last_message_at"),
    )


@check(
    "thread_titles",
    f"""WITH {THREADS}, first AS (SELECT conversation_id, arg_min(content, ordinal) AS q
  FROM message WHERE role = 'user' GROUP BY 1), flat AS (SELECT conversation_id, {FLAT.format("q")} AS q FROM first)
SELECT conversation_id, {TITLE.format("q")} AS title FROM flat""",
)
def thread_titles(spark, folder):
    return conversation.first_questions(messages_of(spark, folder))


def turns_of(spark, folder):
    """Events as new turns of the thread their user number names."""
    known = F.col("user_id")
    return table(spark, folder, "events").select(
        known.alias("conversation_id"),
        F.col("event_id").alias("seq"),
        F.concat_ws(" ", F.lit("about"), "event_type", "props").alias("question"),
        F.concat(F.lit("answer "), F.col("event_id")).alias("answer"),
        F.lit(None).cast("array<struct<chunk_id:string,page:int>>").alias("citations"),
    )


TURNS = """
turn AS (
  SELECT user_id AS conversation_id, event_id AS seq, 'about ' || event_type || ' ' || props AS question,
    'answer ' || event_id AS answer FROM events
),
base AS (SELECT conversation_id, max(ordinal) AS last FROM message GROUP BY 1),
placed AS (
  SELECT t.*, coalesce(last, -1) + 1 + 2 * (row_number() OVER (PARTITION BY conversation_id ORDER BY seq) - 1) AS o
  FROM turn t LEFT JOIN base USING (conversation_id)
)"""


@check(
    "append_turns",
    f"""WITH {THREADS}, {TURNS}
SELECT conversation_id, ordinal, role, content FROM message
UNION ALL SELECT conversation_id, o, 'user', question FROM placed
UNION ALL SELECT conversation_id, o + 1, 'assistant', answer FROM placed""",
)
def append_turns(spark, folder):
    _, after = conversation.append_turns(
        threads_of(spark, folder), messages_of(spark, folder), turns_of(spark, folder)
    )
    return after.select("conversation_id", "ordinal", "role", "content")


@check(
    "titled_threads",
    f"""WITH {THREADS}, {TURNS}, first AS (SELECT conversation_id, arg_min(question, seq) AS q FROM turn GROUP BY 1),
flat AS (SELECT conversation_id, {FLAT.format("q")} AS q FROM first)
SELECT conversation_id, coalesce(title, {TITLE.format("q")}) AS title FROM thread LEFT JOIN flat USING (conversation_id)""",
)
def titled_threads(spark, folder):
    after, _ = conversation.append_turns(
        threads_of(spark, folder), messages_of(spark, folder), turns_of(spark, folder)
    )
    return after.select("conversation_id", "title")


RANGES = """
total AS (SELECT conversation_id, count(*) AS total FROM message GROUP BY 1),
ranges AS (
  SELECT conversation_id, total, summarised_through AS fold_from, total - 6 AS fold_to
  FROM thread JOIN total USING (conversation_id) WHERE total - summarised_through > 6
)"""


@check("summary_ranges", f"WITH {THREADS}, {RANGES} SELECT * FROM ranges")
def summary_ranges(spark, folder):
    return conversation.summary_ranges(threads_of(spark, folder), messages_of(spark, folder))


@check(
    "transcripts",
    f"""WITH {THREADS}, {RANGES}
SELECT conversation_id, (ordinal - fold_from) // 64 AS segment, max(ordinal) + 1 AS through,
  string_agg(role || ': ' || content, chr(10) ORDER BY ordinal) AS transcript
FROM message JOIN ranges USING (conversation_id) WHERE ordinal >= fold_from AND ordinal < fold_to GROUP BY 1, 2""",
)
def transcripts(spark, folder):
    messages = messages_of(spark, folder)
    ranges = conversation.summary_ranges(threads_of(spark, folder), messages)
    return conversation.transcripts(ranges, messages)


@check(
    "fold_summaries",
    f"""WITH {THREADS}, {RANGES}, folded AS (
  SELECT conversation_id, max(ordinal) + 1 AS through, list(role || ': ' || content ORDER BY ordinal) AS said
  FROM message JOIN ranges USING (conversation_id) WHERE ordinal >= fold_from AND ordinal < fold_to GROUP BY 1)
SELECT conversation_id, coalesce(through, summarised_through) AS summarised_through,
  string_split(said[1], chr(10))[1] AS goal
FROM thread LEFT JOIN folded USING (conversation_id)""",
)
def fold_summaries(spark, folder):
    after = conversation.fold_summaries(
        threads_of(spark, folder), messages_of(spark, folder), ports.note_facts
    )
    return after.select("conversation_id", "summarised_through", F.col("summary.goal").alias("goal"))


@check(
    "fold_long_threads",
    """WITH message AS (
  SELECT event_id % 3 AS conversation_id, row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1 AS ordinal,
    event_type || ' e' || (event_id % 50) AS content FROM events),
total AS (SELECT conversation_id, count(*) AS total FROM message GROUP BY 1),
folded AS (SELECT m.*, total FROM message m JOIN total USING (conversation_id) WHERE ordinal < total - 6)
SELECT conversation_id, max(total) - 6 AS summarised_through, 'user: ' || arg_min(content, ordinal) AS goal,
  array_to_string(list_sort(list(DISTINCT split_part(content, ' ', 2))), ',') AS facts
FROM folded GROUP BY 1""",
)
def fold_long_threads(spark, folder):
    """Threads of hundreds or thousands of messages, folded in one call."""
    events = table(spark, folder, "events")
    numbered = ordered.number_rows(
        events.withColumn("conversation_id", F.col("event_id") % 3), ["conversation_id"], ["event_id"],
        ordered.int_bucket(F.col("event_id")), "ordinal",
    )
    messages = numbered.select(
        "conversation_id", "ordinal", F.lit("user").alias("role"),
        F.concat_ws(" ", "event_type", F.concat(F.lit("e"), F.col("event_id") % 50)).alias("content"),
    )
    threads = messages.select("conversation_id").distinct().select(
        "conversation_id", F.lit(0).cast("long").alias("summarised_through"),
        F.lit(None).cast(threads_of(spark, folder).schema["summary"].dataType).alias("summary"),
    )
    # One segment holds a thousand messages here.
    after = conversation.fold_summaries(
        threads, messages, ports.note_facts, Settings(transcript_segment=1000)
    )
    facts = F.array_join(F.array_sort("summary.facts"), ",")
    return after.select("conversation_id", "summarised_through", F.col("summary.goal").alias("goal"), facts.alias("facts"))


@check(
    "resolve_requests",
    f"""WITH {THREADS}, {PRODUCTS}, request AS (
  SELECT event_id AS request_id, props AS question,
    CASE WHEN event_type = 'view' THEN event_id % 10 END AS product_id,
    CASE WHEN event_type IN ('click', 'view') THEN 'token' || (event_id % 12) END AS product_token,
    CASE WHEN event_type IN ('purchase', 'view') AND event_id % 2 = 0 THEN user_id END AS conversation_id
  FROM events),
joined AS (
  SELECT r.*, p.product_id AS by_token, t.product_id AS of_thread, t.conversation_id IS NOT NULL AS known,
    coalesce(r.product_id, p.product_id) AS named
  FROM request r LEFT JOIN product p ON p.public_token = r.product_token
  LEFT JOIN thread t ON t.conversation_id = r.conversation_id)
SELECT request_id, coalesce(named, of_thread) AS resolved_product,
  CASE WHEN product_id IS NULL AND product_token IS NULL AND conversation_id IS NULL THEN 'name a product or a conversation'
    WHEN product_id IS NULL AND product_token IS NOT NULL AND by_token IS NULL THEN 'Unknown product token.'
    WHEN conversation_id IS NOT NULL AND NOT known THEN 'Conversation not found.'
    WHEN conversation_id IS NOT NULL AND named IS NOT NULL AND named IS DISTINCT FROM of_thread
      THEN 'This conversation is about another product. Start a new one.' END AS problem
FROM joined""",
)
def resolve_requests(spark, folder):
    kind, number = F.col("event_type"), F.col("event_id")
    requests = table(spark, folder, "events").select(
        number.alias("request_id"),
        F.col("props").alias("question"),
        F.when(kind == "view", number % 10).alias("product_id"),
        F.when(kind.isin("click", "view"), F.concat(F.lit("token"), number % 12)).alias("product_token"),
        F.when(kind.isin("purchase", "view") & (number % 2 == 0), F.col("user_id")).alias("conversation_id"),
    )
    resolved = conversation.resolve_requests(
        requests, products_of(spark, folder), threads_of(spark, folder)
    )
    return resolved.select("request_id", "resolved_product", "problem")
