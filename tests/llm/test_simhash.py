import random

import xxhash

from citeline.llm import graph
from citeline.llm import simhash as S
from tests.llm.helpers import table, words


def fingerprint(text):
    own = words(text, lower=True)
    runs = [own[i : i + 3] for i in range(len(own) - 2)] if len(own) > 2 else [own] if own else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components(points):
    """Least index of each point's component under links of at most 2 bits."""
    root = list(range(len(points)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(points):
        for j in range(i):
            if (a ^ points[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(points))]


TEXTS = [
    None, "", " \n", "one", "One", "one two", "a b c", "A  B\tc", "a b c d e f g h", "é É a", "x " * 3000,
    "the quick brown fox jumps over the lazy dog again", "the quick brown fox jumps over the lazy dog again",
]


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghijklmnop") + str(i) for i in range(300)]
    texts = list(TEXTS)
    for _ in range(30):
        near = list(base)
        near[rng.randrange(300)] = "other"
        texts.append(" ".join(near))
    rows = [(i, t, "simhash") for i, t in enumerate(texts)]
    docs = table(spark, rows, "doc_id long, text string, component_id string")
    found = {r[0]: tuple(r)[1:] for r in S.digest(S.near_groups(docs)).collect()}
    points = [fingerprint(t) for t in texts]
    want = components(points)
    assert found == {i: (f"{p:016x}", want[i]) for i, p in enumerate(points)}
    assert len(set(want)) < len(set(points))


def test_links_among_dense_and_far_fingerprints(spark):
    rng = random.Random(5)
    points = {0, 1, (1 << 64) - 1, 1 << 63, 3 << 62}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 20)):
            y = x
            for _ in range(rng.choice((0, 1, 1, 2, 2, 3, 4))):
                y ^= 1 << rng.randrange(64)
            points.add(y)
            x = y if rng.random() < 0.3 else x
    points = sorted(points)
    rows = table(spark, [(i, signed(p)) for i, p in enumerate(points)], "doc_id long, simhash long")
    found = {r["fp"]: r["component_id"] for r in S.group(rows).collect()}
    assert found == {signed(p): c for p, c in zip(points, components(points), strict=True)}


def test_cell_is_a_lower_bound_and_the_rows_per_fingerprint_are_fixed(spark):
    rng = random.Random(6)
    points = [rng.getrandbits(64) for _ in range(50)] + [0, (1 << 64) - 1]
    rows = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    from pyspark.sql import functions as F

    for r in rows.select("fp", S.cells_within_one(F.col("fp")).alias("c"), S.words_within_one(F.col("fp")).alias("w")).collect():
        own, *near = [x % (1 << 64) for x in r["c"]]
        digits = [own >> 2 * i & 3 for i in range(32)]
        bits = r["fp"] % (1 << 64)
        assert digits == [(bits >> 2 * i & 3).bit_count() for i in range(32)]
        for n in near:
            assert sum(abs((n >> 2 * i & 3) - d) for i, d in enumerate(digits)) == 1
        assert len(set(r["c"])) == len(r["c"]) <= 65
        assert len(set(r["w"])) == 65


def test_keep_one_keeps_a_row_of_each_group_with_all_columns(spark):
    same = "the quick brown fox jumps over the lazy dog again"
    rows = [
        (5, same, "a", 1), (3, same, "b", 2), (3, same, "b", 2), (None, same, "c", 3),
        (None, "alone with no id in the table", "d", 4), (None, "alone with no id in the table", "d", 4),
        (9, None, None, 5), (8, "", "e", 6), (7, "quite another text of some words", "f", 7),
    ]
    docs = table(spark, rows, "doc_id long, text string, __simhash string, __row int")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted((tuple(r) for r in kept.collect()), key=str)
    assert found == sorted([rows[1], rows[4], rows[7], rows[8]], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_groups(docs).count() == 0
    assert S.keep_one(docs).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(0, i) for i in range(1, 60)] + [(7, 7)]
    found = {r["a"]: r["b"] for r in graph.components(table(spark, chain + hub, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(101, 161)} | {i: 0 for i in range(1, 60)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
