"""Query-log analytics: what is asked, what is answered, at what cost.

query_log: conversation_id, tenant_id, normalized_question, intent, resolved,
feedback, latency_ms, token_cost_usd, created_at. Everything is an aggregate
that combines before the shuffle.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeline.session import settle


def most_asked(log: DataFrame, n: int = 20) -> DataFrame:
    """The n most frequent questions."""
    counted = log.groupBy("normalized_question").agg(F.count("*").alias("asked"))
    return counted.orderBy(F.col("asked").desc(), "normalized_question").limit(n)


def per_product(log: DataFrame, conversations: DataFrame, products: DataFrame) -> DataFrame:
    """Questions per product. The log names no product; its thread does, so
    the log is counted per thread first and only the counts are joined."""
    per_thread = log.groupBy("conversation_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("resolved")).alias("ok")
    )
    return (
        per_thread.join(conversations.select("conversation_id", "product_id"), "conversation_id")
        .groupBy("product_id")
        .agg(F.sum("n").alias("questions"), F.sum("ok").alias("resolved"))
        .join(products, "product_id")
        .select("product_id", "brand", "model", "questions", "resolved")
    )


def resolution(log: DataFrame, clean: bool = True) -> DataFrame:
    """Resolution rate; NULL means still in progress. ``clean`` leaves out
    greetings and rejected junk, which count as resolved but carry no intent."""
    if clean:
        log = log.where("intent IS NOT NULL")
    return log.agg(
        F.count("*").alias("questions"),
        F.count("resolved").alias("finished"),
        F.count_if(F.col("resolved")).alias("resolved"),
        F.avg(F.col("resolved").cast("int")).alias("rate"),
    )


def unanswered(log: DataFrame, n: int = 20) -> DataFrame:
    """The n questions that most often found no answer."""
    return most_asked(log.where("NOT resolved"), n)


def intent_measures() -> list[Column]:
    """Measures per intent; usable in batch and streaming aggregates."""
    return [
        F.count("*").alias("questions"),
        F.avg(F.col("resolved").cast("int")).alias("resolution_rate"),
        F.avg("latency_ms").alias("mean_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"),
        F.avg("feedback").alias("mean_feedback"),
        F.sum("token_cost_usd").alias("cost_usd"),
    ]


def intent_mix(log: DataFrame) -> DataFrame:
    """Share, latency, feedback and cost per intent."""
    median = F.expr("percentile(latency_ms, 0.5)").alias("median_latency_ms")
    return log.groupBy("intent").agg(*intent_measures(), median)


def monthly_usage(log: DataFrame, tenants: DataFrame) -> DataFrame:
    """Questions per tenant and month against the tenant's limit."""
    used = log.groupBy("tenant_id", F.date_trunc("month", "created_at").alias("month")).agg(
        F.count("*").alias("used")
    )
    return used.join(
        tenants.select("tenant_id", "monthly_query_limit"), "tenant_id", "left"
    ).withColumn("over_limit", F.col("used") > F.col("monthly_query_limit"))


#: Values a sketch keeps at its widest. The rank of what it gives for a share is
#: within ``RANK_ERROR`` of that share, however many sketches were merged.
SKETCH_K, RANK_ERROR = 400, 0.02


def latency_sketches(log: DataFrame, unit: str = "hour") -> DataFrame:
    """(period, intent, n, sketch): quantile sketches of the latencies of each
    intent, of a size that does not grow with the log."""
    return (
        log.where("latency_ms IS NOT NULL")
        .groupBy(F.date_trunc(unit, "created_at").alias("period"), "intent")
        .agg(
            F.count("*").alias("n"),
            F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), F.lit(SKETCH_K)).alias("sketch"),
        )
    )


def roll_up(sketches: DataFrame, unit: str) -> DataFrame:
    """Sketches of longer periods, from those of shorter ones alone."""
    return sketches.groupBy(F.date_trunc(unit, "period").alias("period"), "intent").agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_K)).alias("sketch")
    )


def latency_percentiles(sketches: DataFrame, shares=(0.5, 0.9, 0.99)) -> DataFrame:
    """(period, intent, n, share, latency_ms): one row per share."""
    each = [
        F.struct(
            F.lit(float(x)).alias("share"),
            F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(x))).alias("latency_ms"),
        )
        for x in shares
    ]
    return sketches.select("period", "intent", "n", F.inline(F.array(*each)))


#: Questions that a summary of one window keeps at most.
TRACKED = 10_000


def frequent_share(tracked: int) -> float:
    """No question with a larger share of a window's rows can be absent from its
    summary. The summary counts in a table of a power of two that is filled to three
    quarters; what it loses of a count is at most 3.5 parts of that table's size,
    and it lists what surely exceeds this loss: twice the loss is always listed."""
    size = 1 << (-(-tracked * 4 // 3) - 1).bit_length()
    return 2 * 3.5 / size


def question_summaries(log: DataFrame, window: str = "1 day", tracked: int = TRACKED) -> DataFrame:
    """(start, end, n, summary): the frequent questions of each window, in a summary
    whose size does not grow with the log. Works on streams too."""
    return (
        log.groupBy(F.window("created_at", window))
        .agg(F.count("*").alias("n"), F.expr(f"approx_top_k_accumulate(normalized_question, {tracked})").alias("summary"))
        .select("window.start", "window.end", "n", "summary")
    )


def merge_summaries(summaries: DataFrame, window: str, tracked: int = TRACKED) -> DataFrame:
    """Summaries of longer windows, from those of shorter ones alone."""
    return (
        summaries.groupBy(F.window("start", window))
        .agg(F.sum("n").alias("n"), F.expr(f"approx_top_k_combine(summary, {tracked})").alias("summary"))
        .select("window.start", "window.end", "n", "summary")
    )


def most_asked_by_window(
    log: DataFrame, summaries: DataFrame, window: str = "1 day", n: int = 20, tracked: int = TRACKED
) -> DataFrame:
    """(start, end, normalized_question, asked, place): exactly the n most frequent
    questions of each window that has a summary; ties go to the smaller text, a null
    question is one like any other and comes last among equals.

    The questions a summary lists are counted anew in the log, so only their rows
    are grouped. An unlisted question has at most ``frequent_share`` of the rows the
    summary saw, and the rows it did not see (too late for a stream). Where the n-th
    count does not exceed that, or fewer than n are listed, all questions of the
    window are counted.
    """
    known = settle(summaries)
    spans = known.select("start", "end", "n")
    listed = settle(
        known.select("start", F.inline(F.expr(f"approx_top_k_estimate(summary, {tracked})"))).select(
            F.col("start").alias("__start"), F.col("item").alias("__item")
        )
    )
    ends = spans.agg(F.min("start").alias("first"), F.max("end").alias("last")).first()
    at, question = F.col("created_at"), F.col("normalized_question")
    recent = log.where((at >= F.lit(ends["first"])) & (at < F.lit(ends["last"])))
    rows = recent.select(F.window(at, window)["start"].alias("start"), question).join(spans.select("start", "end"), "start")
    asked = rows.join(listed, (F.col("start") == F.col("__start")) & question.eqNullSafe(F.col("__item")), "left_semi")
    counted = settle(_top(asked, n))
    least = counted.where(F.col("place") == n).select("start", F.col("asked").alias("least"))
    totals = rows.groupBy("start").agg(F.count("*").alias("total"))
    unlisted = F.col("n") * frequent_share(tracked) + F.greatest(F.col("total") - F.col("n"), F.lit(0))
    proven = settle(
        spans.join(least, "start").join(totals, "start").where(F.col("least") > unlisted).select("start")
    )
    rest = _top(rows.join(proven, "start", "left_anti"), n)
    return counted.join(proven, "start", "left_semi").unionByName(rest)


def _top(rows: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy("start").orderBy(F.col("asked").desc(), F.col("normalized_question").asc_nulls_last())
    counted = rows.groupBy("start", "end", "normalized_question").agg(F.count("*").alias("asked"))
    return counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
