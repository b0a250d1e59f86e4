"""Retrieval against brute force in numpy, hot terms and copies included."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import checks
from citeline import ports
from citeline.config import Settings
from citeline.operators import ann, search
from citeline.operators.scoring import LEXICAL, TRANSLATED, VECTOR


def corpus(spark, n=300, seed=1):
    """A third of the chunks are copies of one; 'the' is in nearly all."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["the"] + [rng.choice("abcdefgh") + rng.choice("0123") for _ in range(rng.randint(2, 12))]
        vec = [rng.gauss(0, 1) for _ in range(8)]
        if i % 3 == 0 and i:
            words, vec = rows[0][2].split(), rows[0][3]
        rows.append((f"c{i:04d}", f"m{i % 7}", " ".join(words), vec, [1] if i % 11 == 0 else None))
    rows.append(("zero", "m0", "the nothing", [0.0] * 8, None))
    df = spark.createDataFrame(
        rows, "chunk_id string, manual_id string, content string, embedding array<float>, applies_to array<long>"
    )
    return rows, df.repartition(5)


def asked(spark, n=9, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        terms = sorted({"the", rng.choice("abc") + "1", rng.choice("xyz") + "9"})
        vec = [rng.gauss(0, 1) for _ in range(8)]
        other = [rng.gauss(0, 1) for _ in range(8)] if i % 2 else None
        rows.append((i, vec, terms, other, [None, 1, 2][i % 3]))
    df = spark.createDataFrame(
        rows, "question_id int, vector array<float>, terms array<string>, "
        "translated_vector array<float>, product_id long",
    )
    return rows, df


LINKS = [(f"m{i}", p) for i in range(7) for p in (1, 2) if (i + p) % 3]


def brute(rows, questions, scoped, k=20):
    """{(list, question): [(chunk, similarity)]}"""
    out = {}
    for q, vec, terms, other, product in questions:
        open_rows = [
            r for r in rows
            if not scoped or product is None
            or ((r[1], product) in LINKS and (r[4] is None or product in r[4]))
        ]

        def cosine(v, r):
            a, b = np.array(v, np.float32).astype(float), np.array(r[3], np.float32).astype(float)
            size = np.linalg.norm(a) * np.linalg.norm(b)
            return a @ b / size if size else None

        for idx, v in ((VECTOR, vec), (TRANSLATED, other)):
            if v is None:
                continue
            near = [(r[0], cosine(v, r)) for r in open_rows]
            near = [(c, s) for c, s in near if s is not None]
            near.sort(key=lambda x: (-round(x[1], 9), x[0]))
            out[idx, q] = near[:k]
        scored = []
        for r in open_rows:
            words = r[2].split()
            score = sum(sum(1 / i**2 for i in range(1, words.count(t) + 1)) for t in terms) / len(terms)
            if score:
                scored.append((r[0], score, cosine(vec, r)))
        scored.sort(key=lambda x: (-round(x[1], 9), x[0]))
        out[LEXICAL, q] = [(c, s) for c, _, s in scored[:k]]
    return out


def collected(df):
    out = {}
    for r in df.orderBy("list_idx", "question_id", "rank").collect():
        out.setdefault((r.list_idx, r.question_id), []).append((r.chunk_id, r.similarity))
    return out


def same(got, want):
    assert set(got) == {k for k, v in want.items() if v}
    for key, hits in got.items():
        assert [c for c, _ in hits] == [c for c, _ in want[key]], key
        for (_, a), (_, b) in zip(hits, want[key]):
            assert (a is None and b is None) or a == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("block,batch", [(2048, 10_000), (2048, 7), (4, 10_000)])
def test_rankings_match_brute_force(spark, monkeypatch, scoped, block, batch):
    """One block, in one batch and many, and several blocks of at most four
    questions."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    rows, chunks = corpus(spark)
    questions, df = asked(spark)
    if scoped:
        links = spark.createDataFrame(LINKS, "manual_id string, product_id long")
        chunks = search.attach_products(chunks, links, df)
    else:
        df = df.drop("product_id")
    got = search.rank_candidates(chunks, df, s=Settings(question_block_rows=block))
    try:
        same(collected(got), brute(rows, questions, scoped))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_blocks_share_a_scan(spark):
    """Several blocks of questions read the chunks once; only their bytes part them."""
    _, chunks = corpus(spark)
    _, df = asked(spark)
    few = Settings(question_block_rows=4)
    plan = search.rank_candidates(chunks, df.drop("product_id"), s=few)._jdf.queryExecution().analyzed().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
    parted = Settings(question_block_rows=4, question_block_bytes=300)
    key = ["list_idx", "question_id", "rank"]
    one, many = (search.rank_candidates(chunks, df.drop("product_id"), s=s).orderBy(*key).collect() for s in (few, parted))
    assert [(*r[:3], r["rank"]) for r in one] == [(*r[:3], r["rank"]) for r in many]


def test_batches_are_cut_by_what_they_hold():
    import pyarrow as pa

    from citeline.functions.arrow import pieces

    for texts in (["a" * n for n in (5, 0, 90, 3, 3)], [["w"] * n for n in (5, 0, 90, 3, 3)], [None, "x"], []):
        batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["t", "i"])
        cut = list(pieces(batch, "t", 10 if texts and isinstance(texts[0], list) else 2))
        assert [t for p in cut for t in p.column("t").to_pylist()] == texts
        assert max((p.num_rows for p in cut), default=0) <= 2


def test_fusion_keeps_first_seen_order(spark):
    lists = {0: ["a", "b", "c"], 1: ["c", "d"], 2: ["b"]}
    rows = [(i, 1, c, r, r / 10 + i) for i, cs in lists.items() for r, c in enumerate(cs, 1)]
    df = spark.createDataFrame(rows, "list_idx int, question_id int, chunk_id string, rank int, similarity double")
    scores, order = {}, []
    for i in sorted(lists):
        for r, c in enumerate(lists[i], 1):
            scores[c] = scores.get(c, 0.0) + 1 / (60 + r)
            order.append(c) if c not in order else None
    want = sorted(order, key=lambda c: scores[c], reverse=True)
    got = search.reciprocal_rank_fusion(df).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == want
    assert {r.chunk_id: r.score for r in got} == scores
    assert next(r for r in got if r.chunk_id == "b").similarity == pytest.approx(2.1)
    merged = search.merge_hits(df, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.similarity) for r in merged] == [("b", 2.1), ("d", 1.2)]


def test_single_product_scope(spark):
    chunks = spark.createDataFrame(
        [("a", "m1", None), ("b", "m1", [7]), ("c", "m1", [8]), ("d", "m2", None)],
        "chunk_id string, manual_id string, applies_to array<long>",
    )
    links = spark.createDataFrame([("m1", 7), ("m2", 8)], "manual_id string, product_id long")
    scoped = search.scope_to_product(chunks, links, 7)
    assert sorted(r.chunk_id for r in scoped.collect()) == ["a", "b"]
    assert search.scope_to_product(chunks, links, None).count() == 4


def test_no_terms_no_lexical_hits(spark):
    _, chunks = corpus(spark, 20)
    df = spark.createDataFrame([(1, [])], "question_id int, terms array<string>")
    assert search.lexical_topk(chunks, df).count() == 0


def test_hash_embedder_is_stable(spark):
    df = spark.createDataFrame([(1, "clean the filter"), (2, "filter the clean"), (3, None), (4, "...")], "i int, t string")
    rows = {r.i: r.embedding for r in ports.embed(df, "t").collect()}
    assert rows[1] == rows[2] and sum(x * x for x in rows[1]) == pytest.approx(1, abs=1e-5)
    assert set(rows[3]) == set(rows[4]) == {0.0}


def test_ann_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.2]) for i in range(600)]
    chunks = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    questions = spark.createDataFrame(rows[:30], "question_id int, vector array<float>")
    cells = ann.fit_cells(chunks, 6)
    placed = ann.assign_cells(chunks, cells)
    exact = search.vector_topk(chunks, questions, 10)
    found = ann.ann_topk(placed, questions, cells, 2, 10)
    assert found.groupBy("question_id").count().where("count <> 10").count() == 0
    assert ann.recall_against(found, exact).first().recall >= 0.9
    every = ann.ann_topk(placed, questions, cells, 6, 10)
    key = ["question_id", "rank"]
    assert every.select(*key, "chunk_id").orderBy(*key).collect() == exact.select(*key, "chunk_id").orderBy(*key).collect()


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_wide_search_finds_nine_tenths_on_the_given_tables(spark, sf):
    checks.load()
    folder = f"/root/testdata/{sf}"
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    chunks = vectors.selectExpr("vec_id AS chunk_id", "embedding")
    asked_rows = spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id").join(
        chunks, F.col("item_id") == F.col("chunk_id")
    ).selectExpr("item_id AS question_id", "embedding AS vector")
    exact = search.vector_topk(chunks, asked_rows, 20)
    for name in ("ann_topk", "ann_topk_wide"):
        found = checks.QUERIES[name](spark, folder)
        assert ann.recall_against(found, exact).first().recall >= 0.9, name
    # finer cells need a smaller share of the table for as much
    cells = ann.fit_cells(chunks, 64)
    fine = ann.ann_topk(ann.assign_cells(chunks, cells), asked_rows, cells, 40, 20)
    assert ann.recall_against(fine, exact).first().recall >= 0.9


def test_codes_of_zero_and_null_vectors_are_left_out(spark):
    rows = [(1, [0.0, 0.0]), (2, None), (3, [1.0, 0.1]), (4, [-1.0, 5.0]), (5, [2.0, 0.2])]
    chunks = spark.createDataFrame(rows, "chunk_id int, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "question_id int, vector array<float>")
    found = ann.coded_topk(ann.add_codes(chunks), asked, chunks, 2, 1).orderBy("rank").collect()
    assert [(r.chunk_id, r["rank"]) for r in found] == [(3, 1), (5, 2)]
    assert found[0].similarity == pytest.approx(1 / 1.01**0.5, abs=1e-6)


def test_context(spark):
    hits = spark.createDataFrame(
        [(1, 2, "b", 7, 8, "two"), (1, 1, "a", 3, 3, "one")],
        "question_id int, rank int, chunk_id string, page_from int, page_to int, content string",
    )
    assert search.context_text(hits).first().context == (
        "[chunk a · page 3]\none\n\n[chunk b · pages 7-8]\ntwo"
    )


def test_scan_reads_only_what_ranking_needs(spark, folder):
    _, chunks = corpus(spark, 20)
    chunks.write.parquet(f"{folder}/chunks")
    stored = spark.read.parquet(f"{folder}/chunks")
    _, df = asked(spark)
    plan = search.vector_topk(stored, df.drop("product_id", "terms"))._jdf.queryExecution().toString()
    assert "ReadSchema: struct<chunk_id:string,embedding:array<float>>" in plan.replace("...", "")
    assert F is not None and "WindowGroupLimit" in plan


def test_a_task_sends_on_less_and_less():
    """Over many batches, what leaves a task grows far slower than its input."""
    import pyarrow as pa

    from citeline.operators.scoring import Held, QuestionBlock, score_chunks

    rng = np.random.default_rng(3)
    asked_rows = [
        {"question_id": i, "vector": list(rng.normal(size=8)), "terms": [], "translated_vector": None, "product_id": None}
        for i in range(5)
    ]
    block = QuestionBlock.build(asked_rows, pa.int64())
    schema = pa.schema([("list_idx", pa.int32()), ("question_id", pa.int64()), ("chunk_id", pa.int64()),
                        ("score", pa.float64()), ("similarity", pa.float64())])
    held, sent = Held(block, 10), []
    for b in range(60):
        vectors = rng.normal(size=(100, 8))
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(b * 100, b * 100 + 100), pa.int64()), pa.array(vectors.tolist(), pa.list_(pa.float32())),
             pa.nulls(100, pa.list_(pa.string())), pa.nulls(100, pa.list_(pa.int64()))],
            names=["chunk_id", "embedding", "tokens", "products"],
        )
        sent.append(score_chunks(batch, block, (VECTOR,), 10, schema, held).num_rows)
    assert sent[0] == 50 and sum(sent[30:]) < 5 * 30
