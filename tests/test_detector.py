"""Trigram weights against a plain computation."""

import math
from collections import Counter

from citeline.operators import language

TEXTS = [
    (1, "the cat sat on the mat", "en"), (2, "the dog and the log", "en"), (3, "le chat est sur le tapis", "fr"),
    (4, "the the the", None), (5, "", "fr"), (6, None, "en"), (7, "ab", "en"), (8, "der Hund läuft über die Straße", "de"),
    (9, "le chien", None), (10, "zzzz qqqq", None), (11, "die Straße 😀😀😀", "de"), (12, "the cat sat on the mat", "en"),
]


def grams(text, limit=1500):
    text = (text or "")[:limit]
    return [text[i : i + 3] for i in range(len(text) - 2)]


def brute(rows, limit=1500):
    counts, docs = {}, Counter()
    for _, text, lang in rows:
        if lang is not None:
            docs[lang] += 1
            counts.setdefault(lang, Counter()).update(grams(text, limit))
    seen = {g for c in counts.values() for g in c}
    log = lambda x: math.floor(abs(math.log(x)) * 1e6 + 0.5) * (1 if x >= 1 else -1)
    out = {}
    for key, text, _ in rows:
        scores = []
        for lang in docs:
            mass = sum(counts[lang].values()) + len(seen) + 1
            score = log(docs[lang] / sum(docs.values())) + sum(log((counts[lang][g] + 1) / mass) for g in grams(text, limit))
            scores.append((-score, lang))
        out[key] = min(scores)[1]
    return out


def found(spark, rows):
    df = spark.createDataFrame(rows, "id long, text string, language string")
    languages, weights = language.fit_weights(df)
    return {r["id"]: r["language"] for r in language.detect_by_weights(df, "id", languages, weights).collect()}


def test_equals_plain_computation(spark):
    assert found(spark, TEXTS) == brute(TEXTS)


def test_long_texts_and_repeated_rows(spark):
    rows = [(i, t * 400 if t else t, l) for i, t, l in TEXTS]
    assert found(spark, rows) == brute(rows)


def test_no_text_at_all(spark):
    assert found(spark, [(1, None, "en"), (2, "", "en"), (3, None, "fr")]) == {1: "en", 2: "en", 3: "en"}


def test_no_known_language(spark):
    assert found(spark, [(1, "the cat", None)]) == {1: None}


def test_empty_table(spark):
    assert found(spark, []) == {}


def test_a_text_is_one_row_before_it_is_shuffled(spark):
    """Trigrams meet their weights where they are cut, and are taken by character."""
    rows = [(i, "ab\n" * 9 + "\U0001f600xy" * i) for i in range(4)]
    texts = spark.createDataFrame(rows, "id long, text string")
    got = [r.gram for r in language.trigrams(texts.where("id = 2"), ["id"]).collect()]
    assert got == [rows[2][1][i : i + 3] for i in range(len(rows[2][1]) - 2)]
    languages = spark.createDataFrame([("x", -1, -9), ("y", -1, -9)], "language string, prior long, unseen long")
    weights = spark.createDataFrame([("ab\n", "x", 3), ("xy\U0001f600", "y", 50)], "gram string, language string, gain long")
    found = language.detect_by_weights(texts, "id", languages, weights)
    assert {r.id: r.language for r in found.collect()} == {0: "x", 1: "x", 2: "y", 3: "y"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and "gram#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


WIDE = [
    "", "a", "ab", "The cat\tsat", "Straße über ÄÖÜ", "İstanbul ΣΑΣ", "日本語のテキスト", "x😀y 😀😀", "a\nb\x00c", "ñandú — «où»", None,
]


def mllib_features(spark, texts):
    """The features by MLlib's own stages."""
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer

    rows = spark.createDataFrame([(i, t or "") for i, t in enumerate(texts)], "id long, text string")
    for stage in (
        RegexTokenizer(inputCol="text", outputCol="chars", pattern="", minTokenLength=1),
        NGram(n=3, inputCol="chars", outputCol="grams"),
        HashingTF(numFeatures=language.FEATURES, inputCol="grams", outputCol="features"),
    ):
        rows = stage.transform(rows)
    return rows


def test_hashed_trigrams_are_those_of_mllib(spark, monkeypatch):
    import pyarrow as pa

    from citeline.functions import trigrams

    monkeypatch.setattr(trigrams, "PART", 5)
    lower = [r.t for r in spark.createDataFrame([(t,) for t in WIDE], "t string").selectExpr("lower(t) AS t").collect()]
    counted = [Counter() for _ in WIDE]
    for rows, features in trigrams.hashed_trigrams(pa.array(lower, pa.string())):
        for row, feature in zip(rows.tolist(), features.tolist(), strict=True):
            counted[row][feature] += 1
    wanted = mllib_features(spark, WIDE).orderBy("id").collect()
    assert counted == [Counter({int(i): int(v) for i, v in zip(r.features.indices, r.features.values)}) for r in wanted]


def test_detector_is_the_naive_bayes_model_of_all_texts(spark):
    """Fitted on counts, it equals MLlib's model of every text, and judges alike."""
    import numpy as np
    from pyspark.ml.classification import NaiveBayes

    rows = [(t, l or "en") for _, t, l in TEXTS if t is not None] + [("日本語のテキスト", "ja"), ("ab", "ja")]
    texts = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    model = language.train_detector(texts, "text", "lang")
    number = {name: float(i) for i, name in enumerate(model.languages)}
    labels = spark.createDataFrame([(i, number[l]) for i, (_, l) in enumerate(rows)], "id long, label double")
    whole = mllib_features(spark, [t for t, _ in rows]).join(labels, "id")
    bayes = NaiveBayes(featuresCol="features").fit(whole)
    assert np.allclose(model.prior, bayes.pi.toArray(), rtol=0, atol=1e-12)
    assert np.allclose(model.weights, bayes.theta.toArray(), rtol=0, atol=1e-12)
    wanted = {r.id: model.languages[int(r.prediction)] for r in bayes.transform(whole).collect()}
    asked = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "id long, text string")
    found = language.detect(asked, model)
    assert found.columns == ["id", "text", "language"]
    assert {r.id: r.language for r in found.collect()} == wanted
    assert "ArrowEvalPython" in found._jdf.queryExecution().executedPlan().toString()
