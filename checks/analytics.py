"""Query-log analytics over the event table."""

from pyspark.sql import functions as F

from checks import check
from checks.catalogue import PRODUCTS, products_of
from checks.threads import THREADS, threads_of
from citeline.functions import guard
from citeline.functions import text as fx
from citeline.operators import analytics
from citeline.session import settle
from citeline.sources.tables import table
from citeline.streaming.state import intents_by_window as intents_by_window_of


def query_log(spark, folder):
    """Events as logged questions: the type decides the intent."""
    kind, number = F.col("event_type"), F.col("event_id")
    intents = {"click": "how_to", "view": "error_code", "purchase": "safety",
               "signup": "small_talk", "error": "out_of_scope"}
    return table(spark, folder, "events").select(
        F.col("user_id").alias("conversation_id"),
        (F.col("user_id") % 7).alias("tenant_id"),
        fx.normalized_question(F.concat(F.lit("  "), F.upper("props"), kind)).alias("normalized_question"),
        guard.stored_intent(guard.lookup(intents, kind)).alias("intent"),
        F.when(number % 11 != 0, (number % 3 != 0)).alias("resolved"),
        F.when(number % 4 == 0, (number % 5).cast("int")).alias("feedback"),
        F.floor("value").cast("int").alias("latency_ms"),
        F.when(number % 2 == 0, (F.col("value") / 1000).cast("decimal(10,6)")).alias("token_cost_usd"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


LOG = """
query_log AS (
  SELECT user_id AS conversation_id, user_id % 7 AS tenant_id,
    lower(trim('  ' || upper(props) || event_type)) AS normalized_question,
    CASE event_type WHEN 'click' THEN 'how_to' WHEN 'view' THEN 'error_code' WHEN 'purchase' THEN 'safety'
      WHEN 'error' THEN 'out_of_scope' END AS intent,
    CASE WHEN event_id % 11 <> 0 THEN event_id % 3 <> 0 END AS resolved,
    CASE WHEN event_id % 4 = 0 THEN event_id % 5 END AS feedback,
    CAST(floor(value) AS INT) AS latency_ms,
    CASE WHEN event_id % 2 = 0 THEN CAST(value / 1000 AS DECIMAL(10, 6)) END AS token_cost_usd, ts AS created_at
  FROM events
)"""


@check(
    "most_asked",
    f"""WITH {LOG} SELECT normalized_question, count(*) AS asked FROM query_log
GROUP BY 1 ORDER BY asked DESC, normalized_question LIMIT 20""",
)
def most_asked(spark, folder):
    return analytics.most_asked(query_log(spark, folder))


@check(
    "unanswered",
    f"""WITH {LOG} SELECT normalized_question, count(*) AS asked FROM query_log
WHERE NOT resolved GROUP BY 1 ORDER BY asked DESC, normalized_question LIMIT 20""",
)
def unanswered(spark, folder):
    return analytics.unanswered(query_log(spark, folder))


@check(
    "questions_per_product",
    f"""WITH {LOG}, {THREADS}, {PRODUCTS}
SELECT product_id, brand, model, count(*) AS questions, count(*) FILTER (resolved) AS resolved
FROM query_log JOIN thread USING (conversation_id) JOIN product USING (product_id) GROUP BY 1, 2, 3""",
)
def questions_per_product(spark, folder):
    return analytics.per_product(
        query_log(spark, folder), threads_of(spark, folder), products_of(spark, folder)
    )


@check(
    "resolution_rate",
    f"""WITH {LOG} SELECT count(*) AS questions, count(resolved) AS finished,
  count(*) FILTER (resolved) AS resolved, round(avg(resolved::INT), 9) AS rate
FROM query_log WHERE intent IS NOT NULL""",
)
def resolution_rate(spark, folder):
    return analytics.resolution(query_log(spark, folder)).withColumn("rate", F.round("rate", 9))


@check(
    "intent_mix",
    f"""WITH {LOG} SELECT intent, count(*) AS questions, round(avg(resolved::INT), 6) AS resolution_rate,
  round(avg(latency_ms), 6) AS mean_latency_ms, max(latency_ms) AS max_latency_ms,
  round(avg(feedback), 6) AS mean_feedback, CAST(sum(token_cost_usd) AS DOUBLE) AS cost_usd,
  CAST(quantile_cont(latency_ms, 0.5) AS DOUBLE) AS median_latency_ms
FROM query_log GROUP BY intent""",
)
def intent_mix(spark, folder):
    mix = analytics.intent_mix(query_log(spark, folder))
    rounded = {c: F.round(c, 6) for c in ("resolution_rate", "mean_latency_ms", "mean_feedback")}
    return mix.withColumns(rounded | {"cost_usd": F.col("cost_usd").cast("double")})


@check(
    "intents_by_window",
    f"""WITH {LOG} SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H') AS start, intent,
  count(*) AS questions, round(avg(resolved::INT), 6) AS resolution_rate,
  round(avg(latency_ms), 6) AS mean_latency_ms, max(latency_ms) AS max_latency_ms
FROM query_log GROUP BY ALL""",
)
def intents_by_window(spark, folder):
    found = intents_by_window_of(query_log(spark, folder))
    return found.select(
        F.date_format("start", "yyyy-MM-dd HH").alias("start"), "intent", "questions",
        F.round("resolution_rate", 6).alias("resolution_rate"),
        F.round("mean_latency_ms", 6).alias("mean_latency_ms"), "max_latency_ms",
    )


@check(
    "monthly_usage",
    f"""WITH {LOG}, used AS (SELECT tenant_id, date_trunc('month', created_at) AS month, count(*) AS used
  FROM query_log GROUP BY 1, 2)
SELECT tenant_id, strftime(month, '%Y-%m') AS month, used,
  CASE WHEN tenant_id < 6 THEN 1000 + tenant_id * 100 END AS monthly_query_limit,
  CASE WHEN tenant_id < 6 THEN used > 1000 + tenant_id * 100 END AS over_limit FROM used""",
)
def monthly_usage(spark, folder):
    tenants = table(spark, folder, "events").select((F.col("user_id") % 7).alias("tenant_id")).distinct()
    tenants = tenants.where("tenant_id < 6").withColumn(
        "monthly_query_limit", 1000 + F.col("tenant_id") * 100
    )
    used = analytics.monthly_usage(query_log(spark, folder), tenants)
    return used.withColumn("month", F.date_format("month", "yyyy-MM"))


@check(
    "latency_rollup",
    f"""WITH {LOG},
timed AS (SELECT date_trunc('month', created_at)::TIMESTAMP AS period, intent, latency_ms FROM query_log WHERE latency_ms IS NOT NULL),
cut AS (SELECT period, intent, n, unnest([0.5, 0.9, 0.99])::DOUBLE AS share, unnest(v) AS value FROM (
  SELECT period, intent, count(*) AS n, quantile_disc(latency_ms, [0.5, 0.9, 0.99]) AS v FROM timed GROUP BY period, intent)),
placed AS (
  SELECT c.period, c.intent, c.share, c.n, count(*) FILTER (latency_ms < value) / c.n AS low, count(*) FILTER (latency_ms <= value) / c.n AS high
  FROM cut c JOIN timed t ON t.period = c.period AND t.intent IS NOT DISTINCT FROM c.intent
  GROUP BY c.period, c.intent, c.share, c.n, c.value)
SELECT period, intent, share, n, low - 0.02 <= share AND high + 0.02 >= share AS within FROM placed""",
)
def latency_rollup(spark, folder):
    """Monthly latency percentiles from hourly sketches, and whether the rank of
    each is within the stated error."""
    log = query_log(spark, folder).select("created_at", "intent", "latency_ms")
    months = analytics.roll_up(analytics.roll_up(analytics.latency_sketches(log), "day"), "month")
    found = settle(analytics.latency_percentiles(months))
    timed = log.where("latency_ms IS NOT NULL").select(
        F.date_trunc("month", "created_at").alias("period"), F.col("intent").alias("kind"), F.col("latency_ms").alias("took")
    )
    # a row of the log meets the few shares of its own month and intent
    ranks = timed.join(found, (timed["period"] == found["period"]) & timed["kind"].eqNullSafe(found["intent"])).groupBy(
        found["period"], "intent", "share", "n"
    ).agg(
        (F.count_if(F.col("took") < F.col("latency_ms")) / F.col("n")).alias("low"),
        (F.count_if(F.col("took") <= F.col("latency_ms")) / F.col("n")).alias("high"),
    )
    error = analytics.RANK_ERROR
    within = (F.col("low") - error <= F.col("share")) & (F.col("high") + error >= F.col("share"))
    return ranks.select(F.col("period").cast("timestamp_ntz").alias("period"), "intent", "share", "n", within.alias("within"))


@check(
    "most_asked_daily",
    f"""WITH {LOG}, counted AS (
  SELECT date_trunc('day', created_at) AS day, normalized_question, count(*) AS asked FROM query_log GROUP BY ALL)
SELECT strftime(day, '%Y-%m-%d') AS day, normalized_question, asked,
  CAST(row_number() OVER (PARTITION BY day ORDER BY asked DESC, normalized_question) AS INTEGER) AS place
FROM counted QUALIFY place <= 20""",
)
def most_asked_daily(spark, folder):
    """The most frequent questions of every day: candidates from a summary of the
    day, counted anew in the log."""
    log = query_log(spark, folder).select("created_at", "normalized_question")
    found = analytics.most_asked_by_window(log, analytics.question_summaries(log))
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "normalized_question", "asked", "place")


@check(
    "unanswered_monthly",
    f"""WITH {LOG}, counted AS (
  SELECT date_diff('day', TIMESTAMP '1970-01-01', created_at) // 30 AS period, normalized_question, count(*) AS asked
  FROM query_log WHERE NOT resolved GROUP BY ALL)
SELECT strftime(TIMESTAMP '1970-01-01' + to_days(CAST(period * 30 AS INTEGER)), '%Y-%m-%d') AS day, normalized_question, asked,
  CAST(row_number() OVER (PARTITION BY period ORDER BY asked DESC, normalized_question) AS INTEGER) AS place
FROM counted QUALIFY place <= 20""",
)
def unanswered_monthly(spark, folder):
    """What most often found no answer in every 30 days, from the summaries of
    single days merged."""
    log = query_log(spark, folder).where("NOT resolved").select("created_at", "normalized_question")
    months = analytics.merge_summaries(analytics.question_summaries(log), "30 days")
    found = analytics.most_asked_by_window(log, months, "30 days")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "normalized_question", "asked", "place")
