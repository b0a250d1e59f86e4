"""Catalogue state: claims, uploads, deletion, progress, the sink."""

import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from citeline.config import Settings
from citeline.operators import catalog
from citeline.sources import files

NOW = "2024-01-15 12:00:00"


def at(**ago):
    return dt.datetime(2024, 1, 15, 12) - dt.timedelta(**ago)


def manuals(spark):
    rows = [
        (1, "pending", None, None),
        (2, "ready", None, None),
        (3, "processing", at(minutes=5), None),
        (4, "processing", at(seconds=2700 + 60), None),
        (5, "failed", None, "ValueError: broken"),
        (6, "processing", None, None),
    ]
    return spark.createDataFrame(
        rows, "manual_id int, status string, processing_started_at timestamp, error string"
    )


def claim(spark, requests):
    df = spark.createDataFrame(requests, "request_id int, manual_id int, arrival int, force boolean")
    now = F.lit(NOW).cast("timestamp")
    outcomes = catalog.claim(manuals(spark), df, now)
    after = catalog.apply_claims(manuals(spark), outcomes, now)
    return (
        {r.request_id: r for r in outcomes.collect()},
        {r.manual_id: r for r in after.collect()},
    )


def test_one_of_many_wins(spark):
    got, after = claim(spark, [(i, 1, 9 - i, False) for i in range(5)])
    assert [r.request_id for r in got.values() if r.won] == [4]
    assert all("right now" in r.reason for r in got.values() if not r.won)
    assert after[1].status == "processing" and after[1].processing_started_at == at()


def test_which_states_may_be_claimed(spark):
    got, after = claim(spark, [(i, i, 0, False) for i in range(1, 8)])
    assert {i for i, r in got.items() if r.won} == {1, 4, 5, 6}
    assert "successfully (ready)" in got[2].reason and got[7].reason == catalog.NOT_FOUND
    assert after[5].error is None and after[3].processing_started_at == at(minutes=5)


def test_force_takes_ready_but_not_running(spark):
    got, _ = claim(spark, [(1, 2, 5, True), (2, 2, 1, False), (3, 3, 0, True), (4, 2, 6, False)])
    assert got[1].won and not got[2].won and not got[3].won and not got[4].won
    # before the winner the manual was still ready; after it, taken
    assert "successfully (ready)" in got[2].reason and got[2].status_after == "ready"
    assert "right now" in got[4].reason and got[4].status_after == "processing"


def test_products_that_differ_in_case_take_one_link(spark):
    products = spark.createDataFrame(
        [(1, "t", "Acme", "X1"), (2, "t", "ACME", "x1")], "product_id long, tenant_id string, brand string, model string"
    )
    uploads = spark.createDataFrame(
        [(1, "t", "c", "acme", "X1", "other", None, "k")],
        "upload_id long, tenant_id string, checksum string, brand string, model string, type string, title string, storage_key string",
    )
    manuals = spark.createDataFrame([], "manual_id string, tenant_id string, checksum string, created_at int")
    links = spark.createDataFrame([], "manual_id string, product_id string")
    out = catalog.register_uploads(uploads, manuals, products, links)
    assert out["requests"].count() == 1
    assert [r.product_id for r in out["links"].collect()] == ["2"]


def test_a_restart_clears_what_came_before(spark):
    events = spark.createDataFrame(
        [(1, 1, "read", "done", 5, None, None), (1, 2, "extract", "failed", 7, None, "broken"),
         (1, 3, catalog.RESTART, None, None, None, None), (1, 4, "read", "running", None, None, None),
         (2, 9, catalog.RESTART, None, None, None, None)],
        "manual_id long, seq long, step string, status string, duration_ms long, detail string, error string",
    )
    got = {r.manual_id: r.progress for r in catalog.fold_progress(events).collect()}
    assert [p.status for p in got[1]] == ["running"] + ["pending"] * 5
    assert all(p.error is None and p.duration_ms is None for p in got[1])
    assert [p.status for p in got[2]] == ["pending"] * 6


def test_page_sizes_are_bounded(spark):
    with pytest.raises(ValueError, match="200"):
        catalog.list_manuals(manuals(spark), limit=201)


def test_admission(spark):
    rows = [("application/pdf", 10, 10), ("text/html", 1, 1), ("application/pdf", 10, 101), ("application/pdf", 101, 1), (None, 1, 1)]
    df = spark.createDataFrame(rows, "kind string, said int, size int")
    reason = catalog.reject_reason(F.col("kind"), F.col("said"), F.col("size"), Settings(max_upload_bytes=100))
    got = [r[0] for r in df.select(reason).collect()]
    assert got[0] is None and "Only PDF" in got[1] and "exceeds" in got[2] and "exceeds" in got[3] and "Only PDF" in got[4]


def test_same_file_twice_is_one_manual_per_tenant(spark):
    uploads = spark.createDataFrame(
        [
            (1, "a", "x", "Balay", "M1", "oven", "", "k1"),
            (2, "a", "x", "BALAY ", "m2", "oven", None, "k2"),
            (3, "b", "x", "Balay", "M1", "oven", "Mine", "k3"),
            (4, "a", "held", "balay", "m1", "oven", None, "k4"),
            (5, "a", "x", "balay", "m1", "oven", None, "k5"),
        ],
        "upload_id int, tenant_id string, checksum string, brand string, model string, type string, title string, storage_key string",
    )
    manuals = spark.createDataFrame([("old", "a", "held", 0)], "manual_id string, tenant_id string, checksum string, created_at int")
    products = spark.createDataFrame([("p1", "a", "Balay", "M1")], "product_id string, tenant_id string, brand string, model string")
    links = spark.createDataFrame([("old", "p1")], "manual_id string, product_id string")
    new = catalog.register_uploads(uploads, manuals, products, links)
    rows = {(r.tenant_id, r.checksum): r for r in new["manuals"].collect()}
    assert set(rows) == {("a", "x"), ("b", "x")}
    assert rows["a", "x"].title == "Balay M1" and rows["a", "x"].storage_key == "k1"
    assert rows["b", "x"].title == "Mine"
    made = {(r.tenant_id, r.brand, r.model) for r in new["products"].collect()}
    assert made == {("a", "BALAY", "m2"), ("b", "Balay", "M1")}
    assert all(len(r.public_token) == 22 for r in new["products"].collect())
    # The family manual covers both models; the held link is not repeated.
    by_manual = new["links"].groupBy("manual_id").count().collect()
    assert {r.manual_id: r["count"] for r in by_manual} == {
        rows["a", "x"].manual_id: 2, rows["b", "x"].manual_id: 1,
    }
    asked = {r.upload_id: r.manual_id for r in new["requests"].collect()}
    assert asked[1] == asked[2] == asked[5] == rows["a", "x"].manual_id and asked[4] == "old"


def test_delete_cascades_but_not_while_processing(spark):
    m = manuals(spark).withColumn("storage_key", F.concat(F.lit("k"), "manual_id"))
    chunks = spark.createDataFrame([(2, 0), (2, 1), (3, 0), (5, 0)], "manual_id int, ordinal int")
    wanted = spark.createDataFrame([(2,), (3,)], "manual_id int")
    after = catalog.delete_manuals(m, {"chunks": chunks}, wanted)
    assert sorted(r.manual_id for r in after["manuals"].collect()) == [1, 3, 4, 5, 6]
    assert sorted(r.manual_id for r in after["chunks"].collect()) == [3, 5]
    assert [r[0] for r in after["refused"].collect()] == [3]
    assert [r[0] for r in after["storage_keys"].collect()] == ["k2"]
    log = spark.createDataFrame([(1, 2), (2, 4), (3, None)], "id int, manual_id int")
    kept = catalog.set_null(log, "manual_id", wanted).orderBy("id").collect()
    assert [r.manual_id for r in kept] == [None, 4, None]


def test_update_step(spark):
    df = spark.range(1).select(catalog.progress_plan().alias("p"))
    assert [s.status for s in df.first().p] == ["pending"] * 6
    done = catalog.update_step(
        F.col("p"), F.lit("clean"), status=F.lit("done"), duration_ms=F.lit(5).cast("long")
    )
    row = df.select(done.alias("p")).select("p", catalog.progress_totals(F.col("p")).alias("t")).first()
    assert [s.status for s in row.p] == ["pending", "pending", "done", "pending", "pending", "pending"]
    assert row.t.done == 1 and row.t.total_ms == 5
    unknown = catalog.update_step(F.col("p"), F.lit("nope"), status=F.lit("done"))
    assert df.select(unknown.alias("p")).first().p == df.first().p


def test_stats_of_a_document_without_chunks(spark):
    m = spark.createDataFrame([("a",), ("b",)], "manual_id string")
    chunks = spark.createDataFrame(
        [("a", "en", "12345"), ("a", "es", "12")], "manual_id string, language string, content string"
    )
    rows = {r.manual_id: r for r in catalog.manual_stats(m, chunks).collect()}
    assert rows["a"].avg_chunk_chars == 3 and rows["a"].languages == {"en": 1, "es": 1}
    assert rows["b"].avg_chunk_chars is None and rows["b"].chunks is None


def test_integrity(spark):
    child = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "id int, manual_id int")
    assert [r.id for r in catalog.missing_parents(child, "manual_id", manuals(spark), "manual_id").collect()] == [2]
    links = spark.createDataFrame([(1, 1), (1, 1), (1, 2)], "a int, b int")
    assert [tuple(r) for r in catalog.duplicate_keys(links, ["a", "b"]).collect()] == [(1, 1, 2)]


def test_stored_files_and_sweep(spark, folder):
    for name in ("a.pdf", "b.pdf", "new.pdf"):
        with open(f"{folder}/{name}", "wb") as out:
            out.write(name.encode())
    old = time.time() - 7200
    for name in ("a.pdf", "b.pdf"):
        os.utime(f"{folder}/{name}", (old, old))
    read = {r.storage_key: bytes(r.content) for r in files.read_files(spark, folder).collect()}
    assert read == {n: n.encode() for n in ("a.pdf", "b.pdf", "new.pdf")}
    stored = files.list_sweepable(spark, folder, F.current_timestamp())
    assert "content" not in stored.columns
    m = spark.createDataFrame([("a.pdf",), (None,), ("gone.pdf",)], "storage_key string")
    assert [r[0] for r in catalog.orphans(stored, m).collect()] == ["b.pdf"]
    row = catalog.sweep_summary(stored, m).first()
    assert (row.checked, row.referenced, row.orphaned, row.deleted, row.dry_run) == (2, 2, 1, 0, True)
    assert catalog.sweep_summary(stored, m, dry_run=False).first().deleted == 1


def test_chunk_sink_replaces_only_its_documents(spark, folder):
    path = f"{folder}/chunks"
    def rows(version, *docs):
        return spark.createDataFrame(
            [(d, i, version) for d in docs for i in range(3)], "manual_id string, ordinal int, version string"
        )

    files.write_chunks(rows("one", "a", "b", "c", "d"), path, buckets=2)
    files.write_chunks(rows("two", "b").where("ordinal < 2"), path, buckets=2)
    files.write_chunks(rows("two", "b").where("ordinal < 2"), path, buckets=2)
    got = {}
    for r in files.read_chunks(spark, path).collect():
        got.setdefault(r.manual_id, []).append((r.ordinal, r.version))
    assert sorted(got["b"]) == [(0, "two"), (1, "two")]
    assert all(sorted(got[d]) == [(i, "one") for i in range(3)] for d in "acd")


@pytest.mark.parametrize("limit", [None, 1])
def test_only_products_with_a_ready_manual(spark, limit):
    products = spark.createDataFrame(
        [(1, "t", "B", "x"), (2, "t", "A", "y"), (3, "t", "A", "x"), (4, "u", "A", "a")],
        "product_id int, tenant_id string, brand string, model string",
    )
    links = spark.createDataFrame([(2, 1), (2, 2), (1, 3), (2, 4)], "manual_id int, product_id int")
    listed = catalog.list_products(products, links, manuals(spark), "t", limit)
    assert [r.product_id for r in listed.collect()] == [2, 1][:limit]
