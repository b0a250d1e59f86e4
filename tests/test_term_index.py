import collections
import math
import random
import re

import pytest

from citeline.functions import text as fx
from citeline.operators import term_index as I
from citeline.sources.tables import document_chunks, document_texts


def corpus(n=300):
    """One word in every chunk, some often in few, and one chunk of a single word."""
    rng = random.Random(3)
    rows = [(i, " ".join(["common"] * rng.choice([1, 1, 1, 2, 30]) + rng.choices(["E-18", "oven", "filter", "rare"], [5, 5, 5, 1], k=rng.randint(0, 12)))) for i in range(n)]
    return [*rows, (n, None), (n + 1, ""), (n + 2, "only")]


def asked():
    return [(1, "common"), (2, "Common oven"), (3, "rare rare filter E 18"), (4, "unknown"), (5, ""), (6, "only common"), (7, None)]


def brute(rows, questions, k, bm25):
    held = {c: collections.Counter(w for w in _tokens(t)) for c, t in rows}
    n, mean = len(held), sum(sum(x.values()) for x in held.values()) / len(held)
    df = collections.Counter(w for x in held.values() for w in x)
    out = []
    for q, text in questions:
        terms = sorted(set(_tokens(text)))
        scores = {}
        for c, own in held.items():
            for t in terms:
                if own[t] and bm25:
                    idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
                    s = idf * own[t] * 2.2 / (own[t] + 1.2 * (0.25 + 0.75 * sum(own.values()) / mean))
                elif own[t]:
                    s = sum(1 / i**2 for i in range(1, own[t] + 1)) / len(terms)
                else:
                    continue
                scores[c] = scores.get(c, 0) + s
        best = sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
        out += [(q, c, r + 1, round(s, 6)) for r, (c, s) in enumerate(best)]
    return sorted(out)


def _tokens(text):
    return "".join(x if x.isalnum() or x == "_" else " " for x in (text or "").lower()).split()


@pytest.mark.parametrize(("block", "k", "bm25"), [(8, 3, False), (8, 3, True), (256, 20, True), (20, 500, False)])
def test_rankings_equal_brute_force(spark, folder, block, k, bm25):
    chunks = spark.createDataFrame(corpus(), "chunk_id long, content string").repartition(3)
    questions = spark.createDataFrame(asked(), "question_id long, question string")
    index = I.write_index(chunks, f"{folder}/terms", block)
    found = I.ranked(index, questions, k, I.bm25 if bm25 else None).collect()
    assert sorted((r.question_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in found) == brute(corpus(), asked(), k, bm25)


def test_only_blocks_that_may_hold_a_result_are_read(spark, folder):
    """A frequent word's chunks that use it once are passed over, and so are the
    partitions of other terms."""
    rows = [(i, "common " * (9 if i % 100 == 0 else 1) + f"w{i}") for i in range(4000)]
    index = I.write_index(spark.createDataFrame(rows, "chunk_id long, content string"), f"{folder}/terms", 64)
    questions = spark.createDataFrame([(1, "common")], "question_id long, question string")
    terms = I.asked_terms(questions)
    needed = I.needed_blocks(index, terms, I._mean_reciprocals(index), 5).count()
    every = index.blocks(spark).where("term = 'common'").count()
    assert 0 < needed <= every // 10
    plan = I.ranked(index, questions, 5)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*part#", plan) and "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert {r.chunk_id % 100 for r in I.ranked(index, questions, 5).collect()} == {0}


def test_blocks_are_bounded_and_hold_every_posting(spark, folder):
    rows = [(i, "hot " * (i % 3 + 1)) for i in range(5000)]
    index = I.write_index(spark.createDataFrame(rows, "chunk_id long, content string"), f"{folder}/terms", 50)
    held = index.blocks(spark).collect()
    assert sum(r.n for r in held) == 5000 and max(r.n for r in held) < 100


def test_an_empty_corpus(spark, folder):
    index = I.write_index(spark.createDataFrame([], "chunk_id long, content string"), f"{folder}/terms")
    questions = spark.createDataFrame(asked(), "question_id long, question string")
    assert index.chunks == 0 and index.terms.count() == 0
    assert I.ranked(index, questions).count() == 0


def test_postings_are_dealt_by_chunk_once(spark, folder):
    """No shuffle holds a row per question and posting; a repeated question counts as often."""
    chunks = spark.createDataFrame(corpus(), "chunk_id long, content string")
    twice = spark.createDataFrame([(1, "common oven"), (1, "common oven"), (2, "common oven"), (None, "oven")], "question_id long, question string")
    found = I.ranked(I.write_index(chunks, f"{folder}/terms", 8), twice, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(chunk_id", plan) and not re.search(r"hashpartitioning\(question_id#\d+L?, chunk_id", plan)
    rows = {(r.question_id, r["rank"]): (r.chunk_id, r.score) for r in found.collect()}
    assert set(rows) == {(q, n) for q in (1, 2) for n in (1, 2, 3)}
    for n in (1, 2, 3):
        assert rows[1, n][0] == rows[2, n][0] and rows[1, n][1] == pytest.approx(2 * rows[2, n][1])


def test_frequencies_beyond_the_listed_ones(spark, folder, monkeypatch):
    monkeypatch.setattr(I, "LISTED", 3)
    rows = [(i, "hot " * i) for i in range(1, 9)]
    index = I.write_index(spark.createDataFrame(rows, "chunk_id long, content string"), f"{folder}/terms")
    asked_once = spark.createDataFrame([(1, "hot")], "question_id long, question string")
    found = {r.chunk_id: r.score for r in I.ranked(index, asked_once).collect()}
    assert found == {i: pytest.approx(sum(1 / j**2 for j in range(1, i + 1))) for i, _ in rows}


def test_neither_texts_nor_postings_are_shuffled_or_kept(spark, folder, monkeypatch):
    """Blocks are made where the chunks lie; nothing is written besides but repeated ids."""
    kept = []
    settle = I.settle
    monkeypatch.setattr(I, "settle", lambda df: kept.append(settle(df)) or kept[-1])
    chunks = spark.createDataFrame(corpus(), "chunk_id long, content string")
    I.write_index(chunks, f"{folder}/terms")
    assert sum(df.count() for df in kept) == 0
    plan = I._blocks(chunks, 8, fx.tokens)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan


def test_postings_meet_wanted_blocks_without_a_shuffle(spark, folder):
    """Also where wanted blocks are too many to be broadcast."""
    index = I.write_index(spark.createDataFrame(corpus(), "chunk_id long, content string"), f"{folder}/terms", 8)
    questions = spark.createDataFrame(asked(), "question_id long, question string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for score in (None, I.bm25):
            found = I.ranked(index, questions, 3, score)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"hashpartitioning\([^)]*number#", plan) and "postings" in plan
            rows = sorted((r.question_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in found.collect())
            assert rows == brute(corpus(), asked(), 3, score is not None)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("bm25", [False, True])
def test_a_task_of_many_segments(spark, folder, monkeypatch, bm25):
    monkeypatch.setattr(I, "SEGMENT", 50)
    chunks = spark.createDataFrame(corpus(), "chunk_id long, content string").repartition(60).coalesce(2)
    monkeypatch.setattr(I, "bounded_batches", lambda df: spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20") or df)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        index = I.write_index(chunks, f"{folder}/terms", 8)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    places = index.blocks(spark).select(*I.PLACE)
    assert places.distinct().count() == places.count()
    assert places.selectExpr("number >> 24").distinct().count() > 2
    questions = spark.createDataFrame(asked(), "question_id long, question string")
    found = I.ranked(index, questions, 5, I.bm25 if bm25 else None).collect()
    assert sorted((r.question_id, r.chunk_id, r["rank"], round(r.score, 6)) for r in found) == brute(corpus(), asked(), 5, bm25)


def test_rows_of_one_id_are_one_chunk(spark, folder):
    rows = [(1, "oven oven"), (1, "oven oven"), (2, "oven oven oven"), (None, "oven"), (None, "oven"), (3, "filter")]
    index = I.write_index(spark.createDataFrame(rows, "chunk_id long, content string").repartition(4), f"{folder}/terms")
    questions = spark.createDataFrame([(1, "oven")], "question_id long, question string")
    held = [(p.chunk_id, p.tf, p.length) for r in index.blocks(spark).where("term = 'oven'").collect() for p in r.postings]
    assert sorted(held, key=str) == [(1, 4, 2), (2, 3, 3), (None, 2, 1)]
    assert {(r.term, r.df) for r in index.terms.collect()} == {("oven", 3), ("filter", 1)}
    assert index.chunks == 6 and index.mean_length == pytest.approx(10 / 6)
    found = [(r.chunk_id, r["rank"]) for r in I.ranked(index, questions).orderBy("rank").collect()]
    assert found == [(1, 1), (2, 2), (None, 3)]


def test_texts_have_the_rows_of_the_chunk_table(spark, folder):
    docs = [(i, f"text {i}", "en", "web", 6) for i in (1, 2, 2, 3, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    for name, labels in (("once", [1, 3, 9]), ("several", [1, 2, 2, 3, 3, 3, None, None])):
        there = f"{folder}/{name}"
        spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{there}/documents.parquet")
        spark.createDataFrame([(i, 0) for i in labels], "vec_id long, label int").write.parquet(f"{there}/embeddings.parquet")
        want = sorted(map(tuple, document_chunks(spark, there).select("chunk_id", "content").collect()), key=str)
        assert sorted(map(tuple, document_texts(spark, there).collect()), key=str) == want


def test_bounds_of_a_repeated_question_count_as_often(spark, folder):
    """The best chunk has neither term's best block, and a bound of one listing alone would drop it."""
    rows = [(1, "oven " * 9), (2, "filter " * 9), (3, "oven filter " * 2)]
    index = I.write_index(spark.createDataFrame(rows, "chunk_id long, content string"), f"{folder}/terms", 1)
    twice = spark.createDataFrame([(1, "oven filter")] * 2, "question_id long, question string")
    found = [(r.chunk_id, r["rank"], r.score) for r in I.ranked(index, twice, 2).orderBy("rank").collect()]
    assert found == [(3, 1, pytest.approx(2.5)), (1, 2, pytest.approx(sum(1 / i**2 for i in range(1, 10))))]
