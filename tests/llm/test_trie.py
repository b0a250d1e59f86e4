import hashlib
import random
import zlib

import pytest

from citeline.llm import queries, trie
from tests.llm.helpers import table

ROWS = "conv_id long, turn int, role string, text string, n_convs string"


def turns_of(rows):
    """Turns by conversation, as the operator orders them."""
    held = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            held.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))

    def order(x):
        return x[0], x[1], hashlib.sha256(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest()

    return {c: [x[2:] for x in sorted(own, key=order)] for c, own in held.items()}


def expected(held):
    members = {}
    for c, turns in held.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in below)]
        ends = ",".join(map(str, sorted(c for c in own if len(held[c]) == len(node))))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own),
            sum(len(x) == len(node) + 1 for x in below), len(leaves),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-5, 3000), n):
        same = rng.random() < 0.4  # a group of copies
        for turn in range(4 if same else rng.randint(1, 7)):
            role = "user" if turn % 2 == 0 else "assistant"
            rows.append((c, turn, role, f"t{turn}" if same else rng.choice(["é漢", "hello", "hi there", ""]), "x"))
    rows += [(4000, None, None, None, None), (4000, None, "user", "null turn", None), (4000, 1, "user", None, None)]
    rows += [(4001, 3, "a", "b", "x"), (4001, 3, "ab", "", "x"), (4001, 3, "a", "b", "x"), (None, 1, "user", "hello", "x")]
    rows += [(4002 + i, t, "user", f"long {t}", "x") for i in range(3) for t in range(300)]
    return rows


@pytest.mark.parametrize("shard", [1000, 12, 3, 1])
def test_nodes_match_brute_force(spark, shard):
    rows = some_rows(1, 60)
    found = trie.prefix_trie(table(spark, rows, ROWS), shard=shard)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert got(found) == expected(turns_of(rows))


def test_end_lists_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "_PIECE", 1)
    rows = [(c, t, "user", "same", "") for c in range(200) for t in range(2)]
    assert got(trie.prefix_trie(table(spark, rows, ROWS), shard=7)) == expected(turns_of(rows))


def test_empty_tables(spark):
    assert got(trie.prefix_trie(table(spark, [], ROWS))) == []
    assert got(trie.prefix_trie(table(spark, [(None, 1, "a", "b", "")], ROWS))) == []


def test_the_query(spark, folder):
    """Rebuilt conversations, some without turns."""
    rows = some_rows(3, 400)
    spark.createDataFrame(rows, ROWS).drop("n_convs").write.parquet(f"{folder}/conversations.parquet")
    held = turns_of(rows)
    built = {}
    for c, own in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = held.get(donor, [])[:h] + own[h:]
    assert any(not x for x in built.values())
    assert got(queries.QUERIES["op13_trie"](spark, folder)) == expected(built)
