import hashlib
import random
import zlib

import numpy as np
import pytest

from citeline.llm import queries, runs, sql
from tests.llm.helpers import table, words


def brute(w, length, times):
    """Every stretch for every period, the shortest period of each."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items() if b - a >= max(length, times * q))


def collapsed(w, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def texts(seed):
    rng = random.Random(seed)
    out = [[], ["a"], ["a"] * 2, ["a"] * 41, list("ab") * 19 + ["a"], list("aab" * 7 + "c" + "aab" * 5)]
    for _ in range(60):
        out.append([rng.choice("ab" if rng.random() < 0.6 else "abcde") for _ in range(rng.randint(0, 50))])
    for _ in range(20):
        part = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
        out.append(list("xyz") + part * rng.randint(2, 6) + part[: rng.randint(0, len(part))] + list("ab"))
    return out


@pytest.mark.parametrize(("length", "times"), [(1, 2), (6, 3), (2, 2), (10, 4)])
def test_runs_match_brute_force(length, times):
    held = texts(length)
    code = np.array([ord(x) for t in held for x in t], dtype=np.int64)
    first = np.cumsum([0, *(len(t) for t in held)])
    start, end, period = runs.runs_of(code, first, length, times)
    own = np.searchsorted(first, start, side="right") - 1
    got = [[] for _ in held]
    for i, a, b, q in zip(own.tolist(), start.tolist(), end.tolist(), period.tolist(), strict=True):
        got[i].append((a - int(first[i]), b - a, q))
    assert got == [brute(t, length, times) for t in held]


def test_partners_are_looked_up_in_parts(monkeypatch):
    monkeypatch.setattr(runs.suffixes, "_AT_ONCE", 7)
    test_runs_match_brute_force(2, 2)


def test_collapsed_texts_and_rows(spark):
    rows = [(i, " ".join(t), i) for i, t in enumerate(texts(5))]
    rows += [(200, None, 1), (None, "a b " * 20, 2), (201, " \n\t ", None), (3, rows[3][1], 3), (3, rows[3][1], 3)]
    rows += [(202, "é ü\n" * 30 + "end", 1), (203, "p" * 50_000 + " " + "q r " * 20_000, 1)]
    found = runs.find_runs(table(spark, rows, "doc_id long, text string, RUNS int"), length=8)
    assert found.columns == ["doc_id", "text", "runs"]
    got = sorted(((r.doc_id, r.text, [tuple(x) for x in r.runs.runs], r.runs.collapsed, r.runs.n_words) for r in found.collect()), key=str)
    want = []
    for doc, text, _ in rows:
        w = [x.decode() for x in words(text)]
        own = brute(w, 8, 3) if len(w) < 1000 else [(1, 40_000, 2)]
        want.append((doc, text, own, " ".join(collapsed(w, own)), len(w)))
    assert got == sorted(want, key=str)
    empty = runs.find_runs(table(spark, [], "doc_id long, text string"))
    assert empty.count() == 0 and runs.digest(empty).count() == 0


def test_words_are_compared_by_their_bytes(spark):
    """Two words that simple polynomial hashes take for one."""
    one, other = "a", "b"
    while len(one) < 2048:
        one, other = one + other, other + one
    text = " ".join([one, other] * 15)
    found = runs.find_runs(table(spark, [(1, text)], "doc_id long, text string")).first().runs
    assert [tuple(r) for r in found.runs] == [(0, 30, 2)]


def test_the_query(spark, folder):
    """The registered query against plain Python, planted tails included."""
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 5, 60, 200])))) for i in range(150)]
    rows += [(1000, None), (None, "x y " * 30)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op11_runs"](spark, folder).collect()), key=str)
    want = []
    for doc, text in rows:
        w = (text or "").split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
        found = brute(w, 24, 3)
        best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                     sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(collapsed(w, found)))))
    assert got == sorted(want, key=str)
    assert sum(r[1] > 0 for r in got) > 5
    assert "op11_runs" in sql.SQL
