"""Most frequent questions per window: summaries, recounts, and the stream."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeline.operators import analytics
from citeline.streaming import state
from citeline.streaming.log import BatchLog

DAY = datetime.datetime(2024, 1, 1)
FIELDS = "created_at timestamp, normalized_question string"


def log_of(spark, days, hot=400, rare=600):
    """Per day one hot question, nulls, some of middling count and many that are rare."""
    rows = []
    for day in range(days):
        at = [DAY + datetime.timedelta(days=day, seconds=7 * i) for i in range(hot + rare + 400)]
        texts = [f"hot {day}"] * hot + [None] * 100 + [f"mid {i % 10}" for i in range(300)] + [f"rare {i}" for i in range(rare)]
        rows += list(zip(at, texts))
    return spark.createDataFrame(rows, FIELDS), rows


def brute(rows, n, days=1):
    counts = {}
    for at, text in rows:
        start = (at - datetime.datetime(1970, 1, 1)).days // days * days
        counts.setdefault(start, Counter())[text] += 1
    out = set()
    for start, counter in counts.items():
        order = sorted(counter.items(), key=lambda p: (-p[1], p[0] is None, p[0] or ""))
        out |= {(start, text, asked, i + 1) for i, (text, asked) in enumerate(order[:n])}
    return out


def plain(found):
    days = F.datediff("start", F.lit("1970-01-01")).alias("day")
    return {tuple(r) for r in found.select(days, "normalized_question", "asked", "place").collect()}


@pytest.mark.parametrize("tracked", [10_000, 600, 100, 20])
def test_windows_equal_brute_force_however_small_the_summary(spark, tracked):
    log, rows = log_of(spark, 3)
    found = analytics.most_asked_by_window(log, analytics.question_summaries(log, tracked=tracked), n=5, tracked=tracked)
    assert plain(found) == brute(rows, 5)


def test_more_places_than_questions(spark):
    log, rows = log_of(spark, 2, hot=3, rare=2)
    found = analytics.most_asked_by_window(log, analytics.question_summaries(log), n=50)
    assert plain(found) == brute(rows, 50)


def test_merged_summaries_serve_longer_windows(spark):
    log, rows = log_of(spark, 9)
    weeks = analytics.merge_summaries(analytics.question_summaries(log), "7 days")
    assert sum(r["n"] for r in weeks.select("n").collect()) == len(rows)
    assert plain(analytics.most_asked_by_window(log, weeks, "7 days", 8)) == brute(rows, 8, 7)


def test_rows_the_summary_did_not_see_are_counted(spark):
    log, rows = log_of(spark, 1)
    late = [(DAY + datetime.timedelta(hours=20), "late")] * 500
    whole = log.unionByName(spark.createDataFrame(late, FIELDS))
    found = analytics.most_asked_by_window(whole, analytics.question_summaries(log), n=3)
    assert plain(found) == brute(rows + late, 3)


def test_an_empty_log(spark):
    log = spark.createDataFrame([], FIELDS)
    assert plain(analytics.most_asked_by_window(log, analytics.question_summaries(log))) == set()


def test_unlisted_share_is_below_what_the_summary_lists():
    for tracked in (1, 20, 100, 600, 10_000):
        # all that exceed the share fit into the list
        assert 1 / analytics.frequent_share(tracked) <= tracked


def test_stream_equals_batch(spark, folder):
    log, rows = log_of(spark, 3)
    end = spark.createDataFrame([(DAY + datetime.timedelta(days=6), "end")], FIELDS)
    log.orderBy("created_at").coalesce(1).write.parquet(f"{folder}/log")
    kept = BatchLog(spark, f"{folder}/kept", state.ASKED)
    run = lambda: (
        state.most_asked_stream(
            state.live_questions(spark.readStream.schema(FIELDS).parquet(f"{folder}/log")),
            lambda: spark.read.schema(FIELDS).parquet(f"{folder}/log"), kept, n=5,
        ).option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    )
    run()
    end.write.mode("append").parquet(f"{folder}/log")
    run()
    assert plain(kept.read()) == brute(rows, 5)
