import collections
import hashlib
import random

import pytest

from citeline.llm import repeats as R
from citeline.llm.intervals import maximal_repeats
from tests.llm.helpers import table

DOCS = "doc_id long, text string, repeats int"


def expected(docs, length):
    held = [(text or "").encode() for _, text, *_ in docs]
    seen = collections.Counter(t[i : i + length] for t in held for i in range(len(t) - length + 1))
    out = []
    for (doc, *_), t in zip(docs, held, strict=True):
        gone = [False] * (len(t) + 1)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        kept = bytes(c for c, g in zip(t, gone, strict=False) if not g)
        out.append((doc, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, docs, *sizes):
    found = R.strip_repeats(table(spark, docs, DOCS), "doc_id", "text", *sizes)
    assert found.columns == ["doc_id", "text", "repeats"]
    return sorted((tuple(r) for r in R.digest(found).collect()), key=str)


def some_texts(seed, letters):
    rng = random.Random(seed)
    docs = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(0, 120))), 1) for i in range(40)]
    share = "".join(rng.choice("mnopqrst") for _ in range(60))
    for i in range(60):  # overlapping parts of one passage, each in its own surroundings
        a, b = sorted(rng.sample(range(61), 2))
        docs.append((100 + i, f"<{i}>" + share[a:b] + f"<{i * 7}/>" + share[b : b + rng.randint(0, 20)], 1))
    docs += [(200, "z" * 150, 1), (201, "pq" * 60, 1), (202, None, 1), (203, "", 1), (204, "é漢ü" * 20, 1)]
    docs += [(205, "same row, there twice as it stands, letter by letter", 1), (None, share, None)]
    return [*docs, docs[-2], docs[5], docs[5], docs[105 - 40]]


@pytest.mark.parametrize(
    ("length", "anchor", "bucket", "letters"), [(20, 4, 1000, "ab"), (12, 8, 1000, "abcdef"), (24, 8, 3, "ab"), (40, 4, 5, "abc")]
)
def test_removed_bytes_match_brute_force(spark, length, anchor, bucket, letters):
    docs = some_texts(length, letters)
    assert got(spark, docs, length, anchor, bucket) == expected(docs, length)


def test_texts_longer_than_a_part(spark, monkeypatch):
    docs = some_texts(3, "ab")
    monkeypatch.setattr(R, "_POSITIONS", 50)
    assert got(spark, docs, 20, 4, 10) == expected(docs, 20)


def test_the_production_length(spark):
    rng = random.Random(1)
    text = lambda n: "".join(rng.choice("abcdefgh ijklmnop") for _ in range(n))
    share = text(900)
    docs = []
    for i in range(30):
        a = rng.randint(0, 500)
        docs.append((i, text(700) + share[a : a + rng.randint(380, 520)] + text(300), 0))
    assert got(spark, docs, R.LENGTH, R.ANCHOR, R.BUCKET) == expected(docs, R.LENGTH)
    assert got(spark, docs, R.LENGTH, R.ANCHOR, 4) == expected(docs, R.LENGTH)


def test_empty_table(spark):
    assert got(spark, [], 20, 4, 10) == []
    assert R.repeat_groups(table(spark, [], "doc_id long, text string")).count() == 0


def test_maximal_repeats_around_a_place():
    """Against all pairs: what two strings share, with all that share it too."""
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(2, 12)
        both = sorted(("".join(rng.choice("ab") for _ in range(6)).encode(), "".join(rng.choice("ab") for _ in range(6)).encode()) for _ in range(n))
        rights, lefts = [r for r, _ in both], [x for _, x in both]
        want = set()
        for i in range(n):
            for j in range(i):
                right = next((k for k in range(6) if rights[i][k] != rights[j][k]), 6)
                left = next((k for k in range(6) if lefts[i][5 - k] != lefts[j][5 - k]), 6)
                if right and left + right >= 7:
                    members = tuple(m for m in range(n) if rights[m][:right] == rights[i][:right] and lefts[m][6 - left :] == lefts[i][6 - left :])
                    want.add((left, right, members))
        found = [(a, b, tuple(sorted(m))) for a, b, m in maximal_repeats(lefts, rights, 7)]
        assert len(found) == len(set(found)) and set(found) == want


def test_groups_hold_every_occurrence(spark):
    """Whatever is repeated is in a group, and a group names one string only."""
    docs = [(i, t, 0) for i, (_, t, _) in enumerate(some_texts(9, "abc"))]
    length = 16
    for bucket in (1000, 4):
        found = R.repeat_groups(table(spark, docs, DOCS), length=length, anchor=4, bucket=bucket).collect()
        raw = {i: (t or "").encode() for i, t, _ in docs}
        groups = collections.defaultdict(set)
        for r in found:
            groups[r.g1, r.g2].add((r.doc_id, r.start, r.length))
        covered = collections.defaultdict(set)
        for members in groups.values():
            assert len(members) > 1
            assert len({raw[d][a : a + n] for d, a, n in members}) == 1
            for d, a, n in members:
                covered[d] |= set(range(a, a + n))
        removed = {r[0]: r[2] for r in expected(docs, length)}
        assert {d: len(covered[d]) for d in raw} == removed
