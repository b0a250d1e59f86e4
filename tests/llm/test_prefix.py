import collections

from pyspark.sql import functions as F

from citeline.llm.prefix import running_sums


def sums_of(df):
    out = running_sums(df, "key", ["at", "name"], {"n": F.lit(1), "before": F.col("size")})
    assert out.columns == [*[c for c in df.columns if c != "n"], "n", "before"]
    return out.collect()


def check(held, rows):
    groups = collections.defaultdict(list)
    for r in held:
        groups[r["key"]].append(r)
    assert sorted(map(str, [(r["key"], r["at"], r["name"], r["size"]) for r in held])) == sorted(map(str, [r[:4] for r in rows]))
    for group in groups.values():
        group.sort(key=lambda r: r["n"])
        assert [r["n"] for r in group] == list(range(len(group)))
        order = [(r["at"] is not None, r["at"] or 0, r["name"]) for r in group]
        assert order == sorted(order)
        total = 0
        for r in group:
            assert r["before"] == total
            total += r["size"] or 0


def test_hot_null_and_equal_groups_over_many_ranges(spark):
    kind = "key string, at long, name string, size long, __part string, n string"
    rows = [("hot", i % 7, "x", i, "p", "q") for i in range(3000)]
    rows += [("same", 1, "x", 3, "p", "q")] * 3000
    rows += [(None, None, "x", 5, "p", "q")] * 1500
    rows += [(f"k{i % 900}", i, "x", None if i % 5 == 0 else 1, "p", "q") for i in range(2000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        held = sums_of(spark.createDataFrame(rows, kind).repartition(5))
        check(held, rows)
        assert held[0]["__part"] == "p"
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_empty_and_single(spark):
    kind = "key string, at long, name string, size long"
    assert sums_of(spark.createDataFrame([], kind)) == []
    check(sums_of(spark.createDataFrame([("a", 1, "x", 2)], kind)), [("a", 1, "x", 2)])
