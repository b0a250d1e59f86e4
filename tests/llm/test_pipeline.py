import collections
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from citeline.llm import mixing, quality, queries
from tests.llm.helpers import PLAIN, table, words
from tests.llm.test_pii import base
from tests.llm.test_simhash import components, fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long, copies int"


def corpus():
    rng = random.Random(8)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))

    items = [(i, prose(14)) for i in range(5)]
    docs, labels = [], []
    for i in range(250):
        bad = i % 9 == 4
        text = prose(rng.randint(20, 90))
        if bad:
            text = " ".join(w + "$$$" for w in text.split())
        elif i % 23 == 3:
            text += " " + items[i % 5][1] + " " + prose(5)
        elif i % 17 == 2:
            text += " write to some.one@example.org or call +49 30 1234567 please"
        docs.append((i, text))
        labels.append((i, int(not bad), 0))
    docs += [(300 + i, docs[i][1]) for i in range(0, 60, 4)]
    near = prose(400).split()
    for i in range(12):
        own = list(near)
        own[rng.randrange(400)] = "changed"
        docs.append((400 + i, " ".join(own)))
    docs += [(500, None), (501, ""), (502, "ok"), (None, prose(30)), docs[10], docs[10]]
    rows = [(i, t, "en", None if n % 11 == 0 else "hot" if n % 3 else "rare", len(t or ""), n) for n, (i, t) in enumerate(docs)]
    return rows, items, labels


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows, items, labels = corpus()
    folder = str(tmp_path_factory.mktemp("tables"))
    table(spark, rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    table(spark, items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    table(spark, labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, items, labels


def test_every_stage_against_brute_force(spark, tables):
    folder, rows, items, labels = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    kept = {}
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == names, name
        kept[name] = sorted((tuple(r) for r in docs.collect()), key=str)
        docs = table(spark, kept[name], DOCS)

    good = {i for i, y, _ in labels if y}
    first = kept["quality classifier"]
    by = collections.Counter(r[0] for r in first)
    lost = [i for i in good if not by[i]]
    assert len(lost) <= 0.03 * len(good)
    assert not [i for i, y, _ in labels if not y and by[i] and zlib.crc32(str(i).encode()) % 5]
    model = quality.classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    accepted = collections.Counter(r["doc_id"] for r in model.where("predicted = 1").collect())
    assert by == accepted

    roots = components([fingerprint(r[1]) for r in first])
    groups = collections.defaultdict(list)
    for r, c in zip(first, roots, strict=True):
        groups[c].append(r)
    second = kept["SimHash near-dedup"]
    assert len(second) == len(groups)
    of = {r: c for c, g in groups.items() for r in g}
    assert sorted(of[r] for r in second) == sorted(groups)
    for r in second:
        ids = [x[0] for x in groups[of[r]] if x[0] is not None]
        assert r[0] == (min(ids) if ids else None)

    windows = {tuple(words(t, PLAIN, True)[i : i + 10]) for _, t in items for i in range(len(words(t, PLAIN, True)) - 9)}
    def clean(text):
        own = words(text, PLAIN, True)
        return not any(tuple(own[i : i + 10]) in windows for i in range(len(own) - 9))

    third = kept["benchmark decontamination"]
    assert third == [r for r in second if clean(r[1])] and len(third) < len(second)

    hidden = 0
    for before, after in zip(third, sorted(kept["PII"], key=lambda r: third.index(next(x for x in third if x[5] == r[5]))), strict=True):
        assert before[0] == after[0] and before[2:4] == after[2:4]
        assert base(after[1])[:4] == (0, 0, 0, 0)
        if base(before[1])[:4] == (0, 0, 0, 0):
            assert before == after
        else:
            hidden += 1
            assert after[4] == len(after[1]) and "[EMAIL]" in after[1]
    assert hidden

    rates = {r["source"]: r["mean"] for r in mixing.means(docs).collect()}
    times = {
        r["doc_id"]: r["k"]
        for r in docs.select("doc_id", mixing.copies(F.lit(1.0), mixing.SEED, F.col("doc_id")).alias("k")).collect()
    }
    assert set(rates) == {r[3] for r in third} and len(times) == len({r[0] for r in third})
    last = C.STAGES[-1][1](spark, docs, folder)
    assert [c for c in last.columns if c in names] == names


def test_run_is_the_stages_one_after_the_other(spark, tables):
    out = C.run(spark, tables[0])
    held = sorted(out.collect(), key=lambda r: r["order_key"])
    assert held and held == sorted(C.run(spark, tables[0]).collect(), key=lambda r: r["order_key"])
    # files in the order of their names hold rising ranges of the key
    files = out.groupBy(F.input_file_name().alias("file")).agg(F.min("order_key").alias("low"), F.max("order_key").alias("high"))
    ranges = [(r["low"], r["high"]) for r in files.orderBy("file").collect()]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_empty_tables(spark, tmp_path):
    for name, schema in (
        ("documents", DOCS), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int"),
        ("conversations", "conv_id long, turn long, role string, text string"),
    ):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    for name in queries.QUERIES:
        added = int(name == "op7_chat")  # it has a conversation of its own
        assert queries.QUERIES[name](spark, str(tmp_path)).count() == added, name


def test_names_and_stages():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 14))
    assert [n for n, _ in C.STAGES][1] == "SimHash near-dedup" and len(C.STAGES) == 5
    assert set(queries.SQL) <= set(queries.QUERIES)
