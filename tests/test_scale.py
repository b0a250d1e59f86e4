"""Plans and skew: what must hold when one key has a third of the rows."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import checks
from citeline.config import Settings
from citeline.operators import ann, catalog, conversation, ordered, pages, search
from citeline.session import ship

checks.load()


def smoothed(languages):
    out = []
    for i, own in enumerate(languages):
        frame = languages[max(0, i - 2) : i + 3]
        best, n = Counter(frame).most_common(1)[0]
        out.append(best if n > len(frame) // 2 else own)
    return out


def labelled(docs, rng):
    """Rows with gaps in the page numbers, as dropped pages leave them."""
    rows = []
    for d, languages in docs.items():
        page = 0
        for lang in languages:
            page += rng.choice([1, 1, 1, 2, 9])
            rows.append((d, page, lang, rng.randint(1, 9)))
    return rows


def check_docs(spark, docs, bucket):
    s = Settings(order_bucket=bucket)
    rows = labelled(docs, random.Random(bucket))
    df = spark.createDataFrame(rows, "doc_id string, page int, language string, chars int")
    got = pages.language_blocks(df, smooth=True, s=s).orderBy("doc_id", "page").collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, languages in docs.items():
        want, block, offset, last = [], -1, 0, None
        chars = [c for doc, _, _, c in rows if doc == d]
        for lang, n in zip(smoothed(languages), chars):
            if lang != last:
                block, offset, last = block + 1, 0, lang
            want.append((lang, block, offset))
            offset += n + 2
        assert [(r.language, r.block, r.offset) for r in by_doc[d]] == want, d


@pytest.mark.parametrize("bucket", [1, 3, 4096])
def test_blocks_do_not_depend_on_buckets(spark, bucket):
    rng = random.Random(7)
    docs = {f"d{i}": [rng.choice(["en", "en", "en", "es", "lb"]) for _ in range(rng.randint(1, 40))] for i in range(8)}
    docs |= {
        "stray": ["es"] * 4 + ["lb"] + ["es"] * 4,
        "halves": ["es"] * 6 + ["en"] * 6,
        "one": ["el"],
    }
    assert smoothed(docs["stray"]) == ["es"] * 9 and smoothed(docs["halves"]) == docs["halves"]
    check_docs(spark, docs, bucket)


@settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.lists(st.sampled_from(["a", "b", "c"]), min_size=1, max_size=25), min_size=5, max_size=5))
def test_blocks_of_any_languages(spark, docs):
    check_docs(spark, {f"d{i}": d for i, d in enumerate(docs)}, 4)


def test_headings_must_repeat(spark):
    heads = {"x": ["A", "A", "B"], "y": ["B", "C"], "z": [None, "D", "x", "D"]}
    rows = [(d, i, h) for d, hs in heads.items() for i, h in enumerate(hs)]
    df = spark.createDataFrame(rows, "doc_id string, page int, heading string")
    got = pages.confirm_sections(df).orderBy("doc_id", "page").collect()
    assert [r.section for r in got] == ["A", "A", None, None, None, None, "D", None, "D"]


def test_positions(spark):
    rows = [(k, i * 3 % 50) for k in "ab" for i in range(50 if k == "a" else 7)]
    df = spark.createDataFrame(rows, "k string, o int")
    got = ordered.number_rows(df, ["k"], ["o"], ordered.int_bucket(F.col("o"), Settings(order_bucket=4)), "n")
    for k in "ab":
        have = [(r.o, r.n) for r in got.where(F.col("k") == k).collect()]
        assert sorted(have) == [(o, n) for n, o in enumerate(sorted(o for kk, o in rows if kk == k))]


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def eager_skew(spark):
    """Thresholds low enough for the adaptive planner to act on test data."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_manual_is_split_among_tasks(spark, eager_skew):
    n = 30_000
    requests = spark.range(n, numPartitions=8).select(
        F.col("id").alias("request_id"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 500 + 2).alias("manual_id"),
        F.col("id").alias("arrival"),
        F.lit(False).alias("force"),
    )
    manuals = spark.range(1, 503).select(
        F.col("id").alias("manual_id"), F.lit("pending").alias("status"),
        F.lit(None).cast("timestamp").alias("processing_started_at"),
    )
    outcomes = catalog.claim(manuals, requests, F.lit("2024-01-01").cast("timestamp"))
    assert "skew=true" in final_plan(outcomes)
    assert outcomes.where("won").count() == 501 and outcomes.count() == n


def test_hot_heading_is_split_among_tasks(spark, eager_skew):
    rows = spark.range(30_000, numPartitions=8).select(
        F.lit("doc").alias("doc_id"), F.col("id").alias("page"),
        F.when(F.col("id") % 3 == 0, "Safety").otherwise(F.concat(F.lit("h"), F.col("id") % 700)).alias("heading"),
    )
    got = pages.confirm_sections(rows)
    assert "skew=true" in final_plan(got)
    assert got.where("section IS NOT NULL").count() == 30_000


def test_long_thread_is_cut_before_the_shuffle(spark):
    messages = spark.range(5000, numPartitions=8).select(
        (F.col("id") % 1 + 1).alias("conversation_id"), F.col("id").alias("ordinal"),
        F.lit("user").alias("role"), F.col("id").cast("string").alias("content"),
    )
    recent = conversation.recent_messages(messages)
    plan = final_plan(recent)
    partial = plan.index("WindowGroupLimit", plan.index("Exchange hashpartitioning(conversation_id"))
    assert "Partial" in plan[partial : partial + 200]
    assert sorted(r.ordinal for r in recent.collect()) == list(range(4994, 5000))


def test_hot_document_spreads_over_buckets(spark):
    s = Settings(order_bucket=100)
    one = spark.range(1000, numPartitions=4).select(
        F.concat(F.lit("doc"), F.col("id") % 1).alias("doc_id"), F.col("id").alias("page"),
        F.lit("en").alias("language"), F.lit(10).alias("chars"),
    )
    bucketed = one.withColumn("b", ordered.int_bucket(F.col("page"), s))
    assert {r["count"] for r in bucketed.groupBy("doc_id", "b").count().collect()} == {100}
    got = pages.language_blocks(one, s=s)
    assert got.where(F.col("offset") != F.col("page") * 12).count() == 0
    plan = pages.mark_blocks(one, s=s)._jdf.queryExecution().toString()
    assert "hashpartitioning(doc_id" in plan and "__bucket" in plan


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_no_query_multiplies_rows(spark, name):
    """No cross product or nested loop in any registered query."""
    if name in ("answer_questions", "log_entries", "eval_results", "ingest_documents"):
        pytest.skip("built of parts that are checked on their own")
    ship(spark)
    df = checks.QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_a_table_by_cell_is_read_only_where_it_is_probed(spark, folder):
    rows = [(i, [float(np.cos(i)), float(np.sin(i))], i % 5) for i in range(200)]
    chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, label int")
    cells = ann.label_cells(chunks)
    placed = ann.write_cells(chunks, cells, f"{folder}/cells")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "question_id long, vector array<float>")
    found = ann.ann_topk(placed, asked, cells, 2, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    exact = search.vector_topk(chunks, asked, 5)
    assert ann.recall_against(found, exact).first().recall >= 0.6


def test_every_query_has_sql_or_a_reason():
    no_sql = set(checks.QUERIES) - set(checks.SQL)
    assert no_sql == {"chunks_rows", "ingest_documents", "detect_language"}
