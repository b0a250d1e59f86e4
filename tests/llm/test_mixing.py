import collections
import math

import pytest
from pyspark.sql import functions as F

from citeline.llm import mixing
from tests.llm.helpers import table

DOCS = "doc_id long, text string, source string, copy string"


def test_poisson_inverts_the_distribution(spark):
    means, points = [0.0, 0.3, 1.0, 2.5, 4.0], [0.001, 0.2, 0.5, 0.9, 0.999, 1 - 1e-9]
    rows = spark.createDataFrame([(m, u) for m in means for u in points], "m double, u double")
    for r in rows.select("m", "u", mixing.poisson(F.col("m"), F.col("u")).alias("k")).collect():
        k, p = 0, math.exp(-r["m"])
        total = p
        while total <= r["u"]:
            k += 1
            p *= r["m"] / k
            total += p
        assert r["k"] == k


@pytest.mark.parametrize("mean", [0.4, 3.0, 30.0])
def test_draws_have_the_mean_and_the_spread(spark, mean):
    n = 20_000
    found = spark.range(n).select(mixing.copies(F.lit(mean), 1, F.col("id")).alias("k"))
    r = found.agg(F.avg("k").alias("a"), F.var_pop("k").alias("v"), F.avg((F.col("k") == 0).cast("int")).alias("z")).first()
    assert abs(r["a"] - mean) < 5 * math.sqrt(mean / n)
    assert abs(r["v"] / mean - 1) < 0.1
    assert abs(r["z"] - math.exp(-mean)) < 0.02


def docs(spark, n=6000):
    rows = [(i, f"t{i}", "hot" if i % 3 else f"s{i % 5}", "x") for i in range(n)]
    return rows, table(spark, rows, DOCS)


def test_sources_reach_their_weights(spark):
    rows, df = docs(spark)
    weights = spark.createDataFrame([("hot", 1.0), ("s0", 1.0), ("s1", -3.0), ("s2", None), ("no", 5.0)], "source string, weight double")
    found = collections.Counter(r["source"] for r in mixing.mix(df, weights=weights).collect())
    # the share of a source that has no rows is not handed out
    assert set(found) == {"hot", "s0"}
    assert abs(found["hot"] - found["s0"]) < 0.15 * found["hot"]
    assert abs(sum(found.values()) - len(rows)) < 0.1 * len(rows)


def test_flattening_whole_rows_order_and_repeatability(spark):
    rows, df = docs(spark)
    out = mixing.mix(df)
    held = out.collect()
    assert out.columns == ["doc_id", "text", "source", "copy", "order_key"]
    assert held == mixing.mix(df.repartition(7)).collect()
    assert [r["order_key"] for r in held] == sorted(r["order_key"] for r in held)
    by = {r[0]: r for r in rows}
    copies = collections.defaultdict(list)
    for r in held:
        assert (r["text"], r["source"]) == by[r["doc_id"]][1:3]
        copies[r["doc_id"]].append(r["copy"])
    assert all(sorted(c) == list(range(len(c))) for c in copies.values())
    sizes = collections.Counter(r[2] for r in rows)
    total = sum(math.sqrt(n) for n in sizes.values())
    found = collections.Counter(r["source"] for r in held)
    for source, n in sizes.items():
        want = len(rows) * math.sqrt(n) / total
        assert abs(found[source] - want) < 6 * math.sqrt(want)


def test_edge_rows_and_empty_table(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "", None, "x"), (2, "t" * 10**5, "s", "x"), (2, "u", "s", "x")]
    held = mixing.mix(table(spark, rows, DOCS), epochs=20.0).collect()
    count = collections.Counter((r["doc_id"], r["text"]) for r in held)
    assert {k[0] for k in count} == {1, None, 2}
    assert count[(2, "u")] == count[(2, "t" * 10**5)]  # rows that share an id share the draw
    assert count[(1, None)] % 2 == 0
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    plan = mixing.mix(table(spark, rows, DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("ExistingRDD", "") or "ArrowEval" not in plan


def test_a_rare_source_of_large_weight_and_the_number_of_parts(spark):
    rows = [(1, "rare", "rare", "x")] + [(i, "t", "common", "x") for i in range(2, 5002)]
    weights = spark.createDataFrame([("rare", 9.0), ("common", 1.0)], "source string, weight double")
    out = mixing.mix(table(spark, rows, DOCS), weights=weights, part_rows=250)
    held = [(r["doc_id"], r["copy"], r["order_key"]) for r in out.collect()]
    rare = sorted(copy for doc_id, copy, _ in held if doc_id == 1)
    assert len(rare) > 4 * mixing.COPY_BLOCK and rare == list(range(len(rare)))
    assert [k for _, _, k in held] == sorted(k for _, _, k in held)
    assert out.rdd.getNumPartitions() == 21  # 5,001 rows are expected
