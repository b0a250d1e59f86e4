import os

from pyspark.sql import functions as F

from citeline.operators import catalog, evals
from citeline.sources import files


def stored_files(spark, tmp_path, names):
    for name in names:
        (tmp_path / name).write_bytes(b"x")
    return files.list_keys(spark, str(tmp_path), F.current_timestamp() + F.expr("INTERVAL 1 HOUR"))


def test_a_sweep_deletes_what_it_counts(spark, tmp_path):
    stored = stored_files(spark, tmp_path, ["c.pdf", "a.pdf", "b.pdf", "kept.pdf"])
    manuals = spark.createDataFrame([("kept.pdf",), (None,), ("gone.pdf",)], "storage_key string")
    keys, counts = catalog.sweep(stored, manuals)
    assert [tuple(r) for r in keys.collect()] == [("a.pdf", False), ("b.pdf", False), ("c.pdf", False)]
    assert counts.first().asDict() == {"checked": 4, "referenced": 2, "orphaned": 3, "deleted": 0, "dry_run": True}
    assert len(os.listdir(tmp_path)) == 4
    keys, counts = catalog.sweep(stored, manuals, files.unlinker(str(tmp_path)))
    assert [tuple(r) for r in keys.collect()] == [("a.pdf", True), ("b.pdf", True), ("c.pdf", True)]
    assert counts.first().asDict() == {"checked": 4, "referenced": 2, "orphaned": 3, "deleted": 3, "dry_run": False}
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".")] == ["kept.pdf"]


def test_only_plain_names_are_deleted_and_failures_are_not_counted(spark, tmp_path):
    inside = tmp_path / "store"
    inside.mkdir()
    (tmp_path / "outside.pdf").write_bytes(b"x")
    (inside / "folder").mkdir()
    named = [("../outside.pdf",), ("",), ("..",), ("folder",), ("already-gone.pdf",)]
    stored = spark.createDataFrame(named, "storage_key string")
    none = spark.createDataFrame([], "storage_key string")
    keys, counts = catalog.sweep(stored, none, files.unlinker(f"file://{inside}"))
    assert {r["storage_key"] for r in keys.collect() if r["deleted"]} == {"already-gone.pdf"}
    row = counts.first()
    assert (row["orphaned"], row["deleted"]) == (5, 1)
    assert (tmp_path / "outside.pdf").exists() and (inside / "folder").is_dir()
    keys, counts = catalog.sweep(none, none, files.unlinker(str(inside)))
    assert keys.count() == 0 and counts.first()["deleted"] == 0


def test_facts_and_products_by_case_folding(spark):
    rows = spark.createDataFrame([("Die STRASSE ist gross", ["Straße", "GROẞ".lower(), "weg"])], "answer string, facts array<string>")
    assert rows.select(evals.found_facts(F.col("answer"), F.col("facts"))).first()[0] == 2
    cases = spark.createDataFrame([(1, "Weiß", "GT 5")], "id long, brand string, model string")
    products = spark.createDataFrame([(7, "WEISS", "gt 5")], "product_id long, brand string, model string")
    assert evals.resolve_products(cases, products).first()["product_id"] == 7
