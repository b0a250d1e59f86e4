import random
import zlib

import numpy as np
import pytest

from citeline.llm import features as fe
from citeline.llm import quality as Q
from citeline.llm import rules as R
from tests.llm.helpers import table

DOCS = "doc_id long, text string, score string, counts string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(seed=1, n=600):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        own = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(12, 120))]
        if good:
            text = " ".join(own).capitalize() + "."
        else:
            kind = rng.randrange(3)
            text = (
                " ".join(w.upper() + "!!" for w in own)
                if kind == 0
                else " ".join(w + rng.choice(("***", "$$$", "###")) for w in own)
                if kind == 1
                else " | ".join(own)
            )
        docs.append((i, text, "x", "x"))
        labels.append((i, int(good), 0))
    return docs, labels


EDGE = [(9000, None, "x", None), (9001, "", None, "x"), (9002, "w " * 40_000, "x", "x"), (None, "no id here", "x", "x")]


def test_classifier_learns_held_out_labels(spark):
    docs, labels = corpus()
    rows = docs + EDGE + [docs[0], docs[0]]
    odd = [(0, 0, 0), (None, 1, 0), (5, None, 0), (77777, 1, 1)]
    found = Q.classify(table(spark, rows, DOCS), table(spark, labels + odd, LABELS)).collect()
    assert len(found) == len(rows)
    scores = {}
    for r in found:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= Q.THRESHOLD)
        out = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == out
        assert scores.setdefault(r["doc_id"], r["score"]) == r["score"]
    want = {i: y for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0}
    right = sum((scores[i] >= Q.THRESHOLD) == bool(y) for i, y in want.items())
    assert right >= 0.97 * len(want)


def test_score_from_texts_and_from_features_agree_and_training_skips_the_held_out(spark):
    docs, labels = corpus(2, 200)
    df, known = table(spark, docs, DOCS), table(spark, labels, LABELS)
    featured = Q.add_features(df.select("doc_id", "text"))
    model = Q.train(featured, known)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    again = Q.train(featured, table(spark, flipped, LABELS))
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables, strict=True))
    scored = Q.add_score(df, model)
    assert scored.columns == [*df.columns, "quality"]
    direct = {r["doc_id"]: r["quality"]["score"] for r in scored.collect()}
    assert direct == {r["doc_id"]: r["score"] for r in Q.score_features(featured, model).collect()}


def test_pairs_catch_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_without_both_labels_all_score_alike(spark, labels):
    docs = [(i, f"text {i}", "x", "x") for i in range(5)]
    found = Q.classify(table(spark, docs, DOCS), table(spark, labels, LABELS)).collect()
    assert len({r["score"] for r in found}) == 1
    assert Q.classify(spark.createDataFrame([], DOCS), table(spark, labels, LABELS)).count() == 0


def test_rules_and_forest(spark):
    docs, labels = corpus(3)
    rows = docs + EDGE + [(9003, "one two three four five " * 6, "", ""), (9004, "a b c", "", ""), docs[1], docs[1]]
    found = R.judge(table(spark, rows, DOCS), table(spark, labels, LABELS)).collect()
    assert len(found) == len(rows)
    verdict = {}
    for r in found:
        c = r["counts"]
        failed = c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])
        assert verdict.setdefault(r["doc_id"], r["kept"]) == r["kept"]
    good = [verdict[i] for i, y, _ in labels if y]
    bad = [verdict[i] for i, y, _ in labels if not y]
    assert sum(good) > 0.95 * len(good) and sum(bad) < 0.1 * len(bad)
    assert not any(verdict[i] for i in (9000, 9001, 9002, 9003, 9004, None))


def test_forest_isolates_what_lies_apart_and_edges(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(2000, 2)), [[9.0, 9.0], [-9.0, 8.0]]])
    score = R.grow(x).score(x)
    assert score[-2:].min() > np.quantile(score, 0.99)
    assert ((score > 0) & (score < 1)).all()
    assert len(set(R.grow(np.zeros((50, 2))).score(np.zeros((3, 2))))) == 1
    assert len(set(R.grow(np.empty((0, 2))).score(np.ones((3, 2))))) == 1
    assert R.judge(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    docs = [(i, "some words that are not many but ten at least yes", "x", "x") for i in range(3)]
    assert R.judge(table(spark, docs, DOCS), spark.createDataFrame([], LABELS)).where("kept").count() == 3


def test_mean_path_length_of_a_small_sample():
    assert R._expected(1) == 0 and R._expected(2) == 1
    assert abs(R._expected(256) - 10.244) < 0.01
    assert len(fe.RATES) == len(set(fe.RATES))


def test_short_repeated_lines_count_against_a_text(spark):
    def text(i, short):
        return "\n".join(f"w{i:02}{j:02}a w{i:02}{j:02}b w{i:02}{j:02}c\n{short(j)}" for j in range(12))

    rows = [(i, text(i, lambda j: f"ab c{j:02}"), "x", "x") for i in range(60)]
    rows.append((60, text(60, lambda j: "ab c00"), "x", "x"))
    found = {r["doc_id"]: r for r in R.judge(table(spark, rows, DOCS), spark.createDataFrame([], LABELS)).collect()}
    assert found[60]["counts"]["n_dup_lines"] == 11 and not found[60]["base_failed"]
    assert found[60]["anomaly"] > max(found[i]["anomaly"] for i in range(60))
