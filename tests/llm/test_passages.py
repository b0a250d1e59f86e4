import collections
import hashlib
import random

import pytest

from citeline.llm import passages as P
from tests.llm.helpers import table, words

DOCS = "doc_id long, text string, passages int"


def expected(docs, window):
    held = [words(text) for _, text, *_ in docs]
    seen = collections.Counter(tuple(w[i : i + window]) for w in held for i in range(len(w) - window + 1))
    out = []
    for (doc, *_), w in zip(docs, held, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, docs, window, anchor):
    found = P.strip_repeats(table(spark, docs, DOCS), window=window, anchor=anchor)
    assert found.columns == ["doc_id", "text", "passages"]
    return sorted((tuple(r) for r in P.digest(found).collect()), key=str)


@pytest.mark.parametrize(("window", "anchor", "letters"), [(6, 2, "ab"), (7, 3, "abcdef"), (5, 5, "abc"), (9, 1, "ab")])
def test_removed_words_match_brute_force(spark, window, anchor, letters):
    rng = random.Random(window)
    docs = [(i, " ".join(rng.choice(letters) for _ in range(rng.randint(0, 60))), 1) for i in range(40)]
    share = [f"s{i}" for i in range(30)]
    for i in range(30):  # overlapping parts of one passage, each in its own surroundings
        a, b = sorted(rng.sample(range(31), 2))
        docs.append((100 + i, " ".join([f"x{i}", *share[a:b], f"y{i}"]), 1))
    docs += [
        (200, "p q " * 40, 1), (201, "z " * 50, 1), (202, "z\t" * 49, 1), (203, None, 1), (204, "", 1),
        (205, "  ", 1), (206, "only here one two three four five six seven eight", None),
        (207, "same row of words that is there twice as it stands", 1), (None, "é ü é ü é ü é ü é ü é ü", 1),
    ]
    docs += [docs[-2], docs[5], docs[5]]
    assert got(spark, docs, window, anchor) == expected(docs, window)


def test_the_production_window(spark):
    rng = random.Random(1)
    share = [rng.choice("abcdefghij") * 3 + str(rng.randint(0, 99)) for _ in range(60)]
    docs = []
    for i in range(20):
        own = [f"w{rng.randint(0, 10**6)}" for _ in range(80)]
        a = rng.randint(0, 30)
        docs.append((i, " ".join(own[:40] + share[a : a + rng.randint(30, 45)] + own[40:]), 0))
    assert got(spark, docs, P.WINDOW, P.ANCHOR) == expected(docs, P.WINDOW)


def test_empty_table(spark):
    assert got(spark, [], 6, 2) == []


def test_words_that_simple_hashes_confuse(spark):
    """Documents alike but for two words that sums of powers take for one."""
    one, other = "a", "b"
    while len(one) < 2048:
        one, other = one + other, other + one
    rest = [f"w{i}" for i in range(39)]
    docs = [(1, " ".join([*rest[:20], one, *rest[20:]]), 0), (2, " ".join([*rest[:20], other, *rest[20:]]), 0)]
    docs += [(3, f"{one} x y {other} z t", 0), (4, f"{other} x y {other} z t", 0)]
    assert got(spark, docs, P.WINDOW, P.ANCHOR) == expected(docs, P.WINDOW)
    assert got(spark, docs, 5, 2) == expected(docs, 5)


def test_windows_that_no_mask_holds_are_refused(spark):
    with pytest.raises(ValueError, match="63 windows"):
        P.strip_repeats(table(spark, [], DOCS), window=100, anchor=10)
