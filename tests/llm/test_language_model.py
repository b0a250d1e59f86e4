import collections
import math
import random
import zlib

import numpy as np
import pytest

from citeline.llm import attention as A
from citeline.llm import language_model as L
from tests.llm.helpers import table, words

DOCS = "doc_id long, text string, n_tokens string"


def docs(n=120):
    rng = random.Random(4)
    lexicon = [" the", " of", " Ünder", " hello", " world", "\tTab", "\nline", " rare1", " x<|endoftext|>"]
    rows = [(i, "".join(rng.choice(lexicon) for _ in range(rng.randint(0, 60))), "x") for i in range(n)]
    rows += [(1000, None, "x"), (1001, "", None), (1002, "only1 only2 only1", "x"), (None, "no id", "x")]
    rows += [(1003, "long " * 20_000, "x"), rows[3], rows[3]]
    return rows


def held_out(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 10 == 0


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_base_scores_match_brute_force_whatever_is_sent_to_workers(spark, frequent):
    rows = docs()
    found = L.score_texts(table(spark, rows, DOCS), frequent=frequent, least=10_000).collect()
    assert len(found) == len(rows)
    counts = collections.Counter()
    for doc, text, _ in rows:
        if not held_out(doc):
            counts.update([*words(text, lower=True), None])
    n, v = sum(counts.values()), len(counts)
    by = {doc: text for doc, text, _ in rows}
    models = {}
    for r in found:
        own = [*words(by[r["doc_id"]], lower=True), None]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held_out(r["doc_id"]), len(own), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in own)
        want = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert r["base_score"] == pytest.approx(want, rel=1e-9)
        assert r["score"] < 0
        # single precision: sums depend a little on what else is in the batch
        assert models.setdefault(r["doc_id"], r["score"]) == pytest.approx(r["score"], rel=1e-4)
    assert models[1000] == pytest.approx(models[1001], rel=1e-4)


def test_no_training_rows_and_empty_table(spark):
    assert L.score_texts(spark.createDataFrame([], DOCS), least=4_000).count() == 0
    only = [(i, "held out text", "x") for i in range(200) if held_out(i)][:3]
    found = L.score_texts(table(spark, only, DOCS), least=4_000).collect()
    assert len(found) == 3 and all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in found)
    assert all(np.isfinite([r["base_score"], r["score"]]).all() for r in found)


def trained(size=6000, least=120_000):
    rng = np.random.default_rng(2)
    tokens, end = [], 5000
    for _ in range(size // 40):  # the second of two ids follows from the first
        tokens.append(end)
        for _ in range(20):
            a = int(rng.integers(0, 30))
            tokens += [a, 100 + a]
    tokens = np.array(tokens)
    counts = np.bincount(tokens, minlength=end + 1).astype(float)
    codes = A.build_codes(counts, tokens)
    return tokens, counts, codes, A.train(codes, tokens, least)


def test_frequent_ids_have_leaves_of_their_own_and_shares_sum_to_one():
    _, counts, codes, _ = trained(least=1)
    used = codes.code[np.flatnonzero(counts)]
    assert len(set(used.tolist())) == len(used)
    assert codes.code.min() >= 0 and codes.code.max() < A.LEAVES
    sums = np.bincount(codes.code, np.exp(codes.share), minlength=A.LEAVES)
    assert np.allclose(sums[np.unique(codes.code)], 1, atol=1e-4)


def test_probabilities_of_the_next_token_sum_to_one():
    _, counts, codes, weights = trained()
    scorer = A.Scorer(codes, weights)
    context, ids = [3, 103, 7], np.arange(len(counts) - 1)
    # log p(context, x, end) summed over x and over what follows is p(context): compare
    # p(x | context) from texts that differ in x, with the end's probability taken off
    total = 0.0
    part = scorer.score(np.array(context), np.array([0, 3]))[0]
    stream = np.array([[*context, int(i)] for i in ids]).reshape(-1)
    whole = scorer.score(stream, np.arange(0, len(stream) + 1, 4))
    ends = _last_token(scorer, stream.reshape(-1, 4))
    given = part - _last_token(scorer, np.array([context]))[0]
    total = np.exp(whole - ends - given).sum() + np.exp(_last_token(scorer, np.array([context]))[0])
    assert total == pytest.approx(1, abs=1e-3)


def _last_token(scorer, texts):
    """Log probability of the end after each text, by plain attention."""
    w, codes, out = scorer.w, scorer.codes, []
    for text in texts:
        given = codes.code[np.concatenate([[codes.end], text])][-A.WINDOW :]
        x = w["embed"][given]
        a = (x[-1] @ w["query"]) @ (x @ w["key"]).T / np.sqrt(A.WIDTH) + w["distance"][np.arange(len(given))[::-1]]
        a = np.exp(a - a.max())
        h = np.maximum(np.concatenate([x[-1], (a / a.sum()) @ (x @ w["value"])]) @ w["mix"] + w["mix_bias"], 0)
        total, h = 0.0, np.append(h, 1.0)
        for level, (node, branch) in enumerate(A._steps(np.array([codes.code[codes.end]]))):
            logits = h @ w[f"level{level}"][node[0]]
            total += logits[branch[0]] - np.log(np.exp(logits).sum())
        out.append(total)
    return np.array(out)


def test_windows_score_every_token_once_with_its_context(monkeypatch):
    tokens, _, codes, weights = trained()
    scorer = A.Scorer(codes, weights)
    texts = [[], [3], [3, 103] * 30, list(range(17)), [4000, 4001, 100] * 11]
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    flat = np.array([i for t in texts for i in t], dtype=np.int64)
    found = scorer.score(flat, first)
    assert found[0] == pytest.approx(_last_token(scorer, [np.array([], dtype=int)])[0], abs=1e-4)
    monkeypatch.setattr(A, "_AT_ONCE", 16)
    assert np.allclose(scorer.score(flat, first), found, atol=1e-3)
    for i, t in enumerate(texts):  # a text scores the same alone as among others
        assert scorer.score(np.array(t, dtype=np.int64), np.array([0, len(t)]))[0] == pytest.approx(found[i], abs=1e-3)


def test_gradients_match_differences():
    tokens, _, codes, _ = trained(least=1)
    w = {k: v.astype(np.float64) for k, v in A.start_weights(codes).items()}
    rng = np.random.default_rng(0)
    w["distance"] = rng.normal(size=A.WINDOW)
    windows = codes.code[tokens][np.arange(4)[:, None] * 37 + np.arange(A.WINDOW + 1)]
    end = int(codes.code[codes.end])
    _, grads = A._gradients(w, windows, end)
    for name in ("query", "key", "value", "distance", "mix", "mix_bias", "level0", "level1", "level2"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), w[name].shape)
        step = 1e-4
        w[name][at] += step
        high, _ = A._gradients(w, windows, end)
        w[name][at] -= 2 * step
        low, _ = A._gradients(w, windows, end)
        w[name][at] += step
        assert (high - low) / (2 * step) == pytest.approx(grads[name][at], rel=2e-2, abs=1e-5), name


def test_training_uses_the_context():
    tokens, counts, codes, weights = trained(12_000, 1_600_000)
    scorer = A.Scorer(codes, weights)
    untrained = A.Scorer(codes, A.train(codes, tokens[:1], 1))
    first = np.array([0, 40])
    text = np.array([x for a in range(20) for x in (a, 100 + a)])
    assert scorer.score(text, first)[0] > untrained.score(text, first)[0] + 20
    other = np.array([x for a in range(20) for x in (a, 100 + (a + 7) % 30)])
    assert scorer.score(text, first)[0] > scorer.score(other, first)[0] + 20


def test_all_tokens_are_fitted_wherever_they_stand(spark, monkeypatch):
    """Far into a long text, and in a corpus that many tasks go through."""
    rng = random.Random(6)
    pairs = [(f"w{i}", f"v{i}") for i in range(20)]
    long = " ".join(["filler"] * 6000 + [w for _ in range(4000) for w in rng.choice(pairs)])
    training = [i for i in range(100) if not held_out(i)]
    rows = [(training[0], long, "x")] + [(i, "short text", "x") for i in training[1:10]]
    tested = [i for i in range(100) if held_out(i)][:2]
    rng = random.Random(7)
    good = [rng.choice(pairs) for _ in range(60)]
    shifted = [v for _, v in good[7:] + good[:7]]
    rows += [(tested[0], " ".join(w for p in good for w in p), "x")]
    rows += [(tested[1], " ".join(w for (a, _), b in zip(good, shifted, strict=True) for w in (a, b)), "x")]
    found = {r["doc_id"]: r["score"] for r in L.score_texts(table(spark, rows, DOCS), least=2_000_000).collect()}
    assert found[tested[0]] > found[tested[1]] + 10


def test_company_and_windows_cover_every_token(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(i % 90)), "x") for i in range(300)]
    docs = table(spark, rows, DOCS)
    training = docs.where(~L.held_out("doc_id"))
    counted = L._with_pieces(L.count_words(training, "text"), L.TOKENIZER)
    size = L.pieces(L.TOKENIZER).size
    ids = np.append(L._id_counts(counted, size), float(training.count()))
    frequent, _ = L._frequent(counted, 20)
    running = L._running(training, "doc_id", "text", frequent, L.TOKENIZER)
    texts = [np.frombuffer(r["ids"], dtype=np.uint16).astype(int) for r in running.collect()]
    assert len(texts) == training.count() and sum(map(len, texts)) + len(texts) == ids.sum()
    end = size
    whole = A.company_of(ids, [np.concatenate([[end], t, [end]]) for t in texts])
    assert whole.sum() > 0 and np.array_equal(L._company(running, ids), whole)
    seen = np.zeros(1000, dtype=int)
    fitter = A.Fitter({"a": np.zeros(1)}, 0)
    monkeypatch.setattr(fitter, "adjust", lambda windows, rate: np.add.at(seen, windows[:, 1:], 1))
    fitter.walk(np.arange(1000), A.rate_after)
    assert seen[0] == 0 and (seen[1:] >= 1).all() and seen.sum() < 1040


def test_more_text_is_more_fitted_on(monkeypatch):
    assert A.passes_over(10, 20) == 2 and A.passes_over(10**9, A.SEEN) == 1
    widths = []
    monkeypatch.setattr(A.Fitter, "adjust", lambda self, windows, rate: widths.append(len(windows)))
    tokens, counts, codes, _ = trained(least=1)
    for n in (40_000, 80_000):
        widths.clear()
        A.train(codes, np.resize(tokens, n), 10_000)
        assert sum(widths) == -(-(n - 1) // A.WINDOW)


def test_scores_do_not_depend_on_files(spark, folder):
    """The same rows in one file and in eight, dealt to several parts."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(80)), "x") for i in range(120)]
    spark.createDataFrame(rows, DOCS).coalesce(1).write.parquet(f"{folder}/one")
    spark.createDataFrame(rows[::-1], DOCS).repartition(8).write.parquet(f"{folder}/eight")
    one, eight = (
        {r["doc_id"]: r["score"] for r in L.score_texts(spark.read.parquet(f"{folder}/{n}"), least=4_000).collect()} for n in ("one", "eight")
    )
    assert one.keys() == eight.keys()
    assert all(one[k] == pytest.approx(eight[k], rel=1e-5) for k in one)


def test_words_that_simple_hashes_confuse(spark):
    one, other = "a", "b"
    while len(one) < 2048:
        one, other = one + other, other + one
    free = [i for i in range(20) if not held_out(i)]
    rows = [(free[0], one, "x"), (free[1], f"{one} {one}", "x"), (free[2], other, "x")]
    found = {r["doc_id"]: r for r in L.score_texts(table(spark, rows, DOCS), least=1_000).collect()}
    scale = 7 + 0.1 * 4
    assert found[free[0]]["base_score"] == pytest.approx(math.log10(3.1 / scale) + math.log10(3.1 / scale))
    assert found[free[2]]["base_score"] == pytest.approx(math.log10(1.1 / scale) + math.log10(3.1 / scale))


def test_parts_are_gone_through_once():
    """Hashes deal unevenly: no part may fall short of what it is to see."""
    rng = np.random.default_rng(3)
    sizes = rng.lognormal(7, 0.7, 40_000).astype(int)
    tokens = int(sizes.sum())
    for k in (4, 7, 15):
        least = int(tokens / (k + 0.02))  # nearly so many parts as there is room for
        parts = L.parts_of(tokens, least)
        dealt = np.bincount(rng.integers(0, parts, len(sizes)), sizes, minlength=parts).astype(int)
        assert [A.passes_over(n, least) for n in dealt] == [1] * parts
        assert parts > tokens / least / 1.5
    assert L.parts_of(0, 10) == L.parts_of(19, 10) == 1


def test_texts_are_cut_once_for_fitting_and_scoring(spark):
    rows = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(i % 60)), "x") for i in range(200)]
    model, counts, running = L.learn(table(spark, [*rows, (None, None, "x")], DOCS), least=4_000)
    assert counts.columns == ["word", "c"] and running.count() == len(rows) + 1
    size = L.pieces(L.TOKENIZER).size
    fitted = running.where(~L.held_out("doc_id"))
    cut = L._with_pieces(L.count_words(table(spark, rows, DOCS).where(~L.held_out("doc_id")), "text"), L.TOKENIZER)
    assert np.array_equal(L._id_counts(fitted.select("ids"), size, L._kind(size)), L._id_counts(cut, size))
    found = {r["doc_id"]: r["model"] for r in L._scored(running, model.scorer).collect()}
    for doc, text, _ in rows[::17]:
        ids = np.array([i for x in L.pieces(L.TOKENIZER)(text.encode().split()) for i in x], dtype=int)
        own = model.scorer.score(ids, np.array([0, len(ids)]))[0] / np.log(10)
        assert found[doc] == pytest.approx(own, rel=1e-4)


def test_pieces_of_the_work_do_not_change_it(monkeypatch):
    tokens, counts, codes, weights = trained()
    scorer, end = A.Scorer(codes, weights), int(codes.code[codes.end])
    windows = codes.code[tokens][np.arange(40)[:, None] * 37 + np.arange(A.WINDOW + 1)]
    first = np.array([0, 3, 3, 60, 61, 400])
    loss, grads = A._gradients(weights, windows, end)
    company, scores = A.company_of(counts, [tokens[:900], tokens[900:2000]]), scorer.score(tokens[:400] % end, first)
    assert np.allclose(scorer.score(tokens[:400] % end, first[2:]), scores[2:], rtol=1e-4)
    monkeypatch.setattr(A, "_SORTED", 8)
    monkeypatch.setattr(A, "_CELLS", 64)
    monkeypatch.setattr(A, "_AT_ONCE", 16)
    again, others = A._gradients(weights, windows, end)
    assert again == pytest.approx(loss, rel=1e-5)
    assert all(np.allclose(others[k], grads[k], rtol=1e-3, atol=1e-6) for k in grads)
    assert np.array_equal(A.company_of(counts, [tokens[:900], tokens[900:2000]]), company)
    assert np.allclose(scorer.score(tokens[:400] % end, first), scores, rtol=1e-4)
