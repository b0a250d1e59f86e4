import random

import pytest
from pyspark.sql import functions as F

from citeline.operators import analytics, evals

WANTED = "id int, manual_id string, page_from int, page_to int"
CHUNKS = "chunk_id int, manual_id string, page_from int, page_to int"


def ranges(rng, n, names):
    out = []
    for i in range(n):
        a = rng.randint(1, 60)
        out.append((i, rng.choice(names), a, a + rng.choice([-1, 0, 0, 1, 7, 8, 9, 40])))
    return [*out, (n, "m0", None, 5), (n + 1, "m0", 5, None), (n + 2, None, 1, 9), out[0]]


@pytest.mark.parametrize("width", [1, 3, 8, 100])
def test_overlaps_match_all_pairs(spark, width):
    rng = random.Random(width)
    asked, held = ranges(rng, 40, ["m0", "m1"]), ranges(rng, 80, ["m0", "m0", "m0", "m1", "m2"])
    found = evals.page_overlaps(spark.createDataFrame(asked, WANTED), spark.createDataFrame(held, CHUNKS), width)
    want = []
    for i, m, a, b in asked:
        for c, n, x, y in held:
            if m is not None and m == n and None not in (a, b, x, y) and a <= b and x <= y and max(a, x) <= min(b, y):
                want.append((i, m, c, max(a, x), min(b, y)))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_a_manual_with_most_chunks_is_many_keys(spark):
    held = spark.range(20_000).selectExpr("id AS chunk_id", "'m' AS manual_id", "id % 4000 + 1 AS page_from", "id % 4000 + 2 AS page_to")
    bins = held.select(F.floor((F.col("page_from") - 1) / evals.BIN).alias("b")).groupBy("b").count()
    assert bins.agg(F.max("count")).first()[0] <= 20_000 * evals.BIN // 4000
    asked = spark.createDataFrame([(1, "m", 10, 11)], WANTED)
    assert evals.page_overlaps(asked, held).count() == 15


def test_percentiles_roll_up_within_the_stated_error(spark):
    rng = random.Random(8)
    rows = [(f"2024-0{rng.randint(1, 3)}-1{rng.randint(0, 9)} {rng.randint(10, 23)}:00:00", rng.choice(["a", "b", None]), int(rng.lognormvariate(6, 1.5))) for _ in range(20_000)]
    rows += [("2024-01-10 10:00:00", "none", None)]
    log = spark.createDataFrame(rows, "at string, intent string, latency_ms int").withColumn("created_at", F.to_timestamp("at"))
    days = analytics.roll_up(analytics.latency_sketches(log), "day")
    months = analytics.roll_up(days, "month")
    found = analytics.latency_percentiles(months).collect()
    assert len(found) == 3 * 3 * 3
    for r in found:
        own = sorted(t for at, intent, t in rows if at[:7] == str(r.period)[:7] and intent == r.intent and t is not None)
        assert r.n == len(own)
        low, high = (sum(f(t) for t in own) / len(own) for f in (lambda t: t < r.latency_ms, lambda t: t <= r.latency_ms))
        assert low - analytics.RANK_ERROR <= r.share <= high + analytics.RANK_ERROR
