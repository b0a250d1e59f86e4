import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from citeline.llm import features
from citeline.llm import words as W
from tests.llm.helpers import PLAIN, WORD, words

TEXTS = st.lists(st.one_of(st.none(), st.text("ab A\n\t\x00é中.1", max_size=30)), max_size=6)


def taken(batch, letters):
    found = []
    for _, data, offsets in W.units(batch, "text"):
        own = W.split(data, offsets, letters)
        joined, start, end = own.joined()
        assert joined == b" ".join(joined[a:b] for a, b in zip(start, end, strict=True))
        for i in range(len(offsets) - 1):
            at = range(own.first[i], own.first[i + 1])
            found.append([(joined[start[j] : end[j]], int(own.hash[j])) for j in at])
    return found


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern_and_equal_words_hash_alike(texts):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for letters, pattern, lower in ((W.SPACED, WORD, False), (W.LETTERS_LOWER, PLAIN, True)):
        found = taken(batch, letters)
        assert [[w for w, _ in x] for x in found] == [words(t, pattern, lower) for t in texts]
        hashes = {}
        for w, h in (p for x in found for p in x):
            assert hashes.setdefault(w, h) == h
        assert len(set(hashes.values())) == len(hashes)


def test_a_text_longer_than_a_unit_is_walked_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(500))
    batch = pa.RecordBatch.from_pydict({"text": [text, "w1 w2"]})
    whole = taken(batch, W.SPACED)
    monkeypatch.setattr(W, "UNIT", 64)
    assert taken(batch, W.SPACED) == whole


def test_rolling_hash_of_equal_runs_is_equal(monkeypatch):
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 5, 400).astype(np.uint64)
    for k in (1, 5, 12):
        want = {}
        for size in (1 << 20, 37):
            monkeypatch.setattr(W, "UNIT", size)
            rolled = W.rolling(hashes, k)
            assert len(rolled) == 401 - k
            for i, h in enumerate(rolled.tolist()):
                assert want.setdefault(tuple(hashes[i : i + k].tolist()), h) == h
        assert len(set(want.values())) == len(want)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_counts_match_plain_python(texts):
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for _, data, offsets in W.units(batch, "text"):
        found = features.counts(data, offsets)
        for i, text in enumerate(texts):
            own = words(text)
            runs = [tuple(own[j : j + 5]) for j in range(len(own) - 4)]
            again = {j + d for j, r in enumerate(runs) if runs.count(r) > 1 for d in range(5)}
            lines = [x for x in (text or "").split("\n") if words(x)]
            assert found["n_words"][i] == len(own)
            assert found["word_chars"][i] == sum(len(w.decode()) for w in own)
            assert found["n_repeat_words"][i] == len(again)
            assert found["n_dup_lines"][i] == len(lines) - len(set(lines))
            assert found["n_distinct"][i] == len(set(own))
        assert np.isfinite(features.rates(found)).all()
