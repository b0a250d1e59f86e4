import gc
import hashlib
import random
import weakref

import pytest

from citeline.llm import decontaminate as D
from tests.llm.helpers import PLAIN, table, words

DOCS, ITEMS = "doc_id long, text string, benchmark_hits string", "item_id long, text string"


def expected(docs, items, window=10):
    out = {}
    tests = {}
    for name, text in items:
        own = words(text, PLAIN, True)
        n = min(window, len(own))
        for i in range(len(own) - n + 1) if n else ():
            tests.setdefault(tuple(own[i : i + n]), set()).add("null" if name is None else str(name))
    for doc, text, *_ in docs:
        own, hit, found = words(text, PLAIN, True), set(), set()
        for n in {len(t) for t in tests}:
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) in tests:
                    hit |= set(range(i, i + n))
                    found |= tests[tuple(own[i : i + n])]
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.setdefault(doc, []).append((len(own), len(hit), len(found), sha, bool(hit)))
    return {k: sorted(v) for k, v in out.items()}


def got(spark, docs, items, **more):
    found = D.search_items(table(spark, docs, DOCS), table(spark, items, ITEMS), **more)
    out = {}
    for r in D.digest(found).collect():
        out.setdefault(r[0], []).append(tuple(r)[1:])
    return {k: sorted(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randint(0, 16)))) for i in range(60)]
    items += [(7, "Ä ö ü"), (None, "x y"), (900, None), (901, ""), (902, "..."), (903, items[3][1])]
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 80))), "x") for i in range(50)]
    docs += [(100 + i, f"q r {t or ''} s, {t or ''}", "x") for i, t in items if i is not None]
    docs += [(500, None, "x"), (501, "", "x"), (502, "ä Ö ü ö", None), (502, "X, y!", "x"), (None, "x y", "x")]
    docs += [docs[3], docs[3], (600, " ".join(["long"] * 50000 + ["x", "y"]), "x")]
    return docs, items


def test_words_hit_and_items_found_match_brute_force(spark, case):
    assert got(spark, *case) == expected(*case)


def test_blocks_and_pieces_of_items_give_the_same(spark, case, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BYTES", 600)
    monkeypatch.setattr(D, "PIECE_BYTES", 40)
    assert len(D.item_blocks(table(spark, case[1], ITEMS), "item_id", "text")) > 1
    assert got(spark, *case) == expected(*case)


def test_other_window(spark, case):
    assert got(spark, *case, window=3) == expected(*case, window=3)


def test_empty_tables(spark, case):
    docs, items = case
    assert got(spark, [], items) == {}
    assert got(spark, docs, []) == expected(docs, [])


def test_spans_cover_the_hits_and_other_columns_stay(spark, case):
    docs, items = case
    found = D.search_items(table(spark, docs, "doc_id long, text string, n_hit string"), table(spark, items, ITEMS))
    assert found.columns == ["doc_id", "text", "n_hit", "benchmark_hits"]
    for r in found.collect():
        hits = r["benchmark_hits"]
        assert sum(s["end"] - s["start"] for s in hits["spans"]) == hits["n_hit"]
        assert r["n_hit"] in ("x", None)


def test_one_block_of_items_is_held_at_a_time(spark, case, monkeypatch):
    alive, most = weakref.WeakSet(), []

    class Counted(D.Patterns):
        def __init__(self, items, window):
            super().__init__(items, window)
            alive.add(self)
            gc.collect()
            most.append(len(alive))

    monkeypatch.setattr(D, "BLOCK_BYTES", 600)
    made = D.item_blocks(table(spark, case[1], ITEMS), "item_id", "text")
    monkeypatch.setattr(D, "Patterns", Counted)
    for _ in made:
        pass
    assert len(made) > 2 and len(most) == len(made) and max(most) <= 2
    monkeypatch.undo()
    monkeypatch.setattr(D, "BLOCK_BYTES", 600)
    found = D.search_items(table(spark, case[0], DOCS), table(spark, case[1], ITEMS))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
