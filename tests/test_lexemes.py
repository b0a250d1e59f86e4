import time

import pytest
from pyspark.sql import functions as F

from citeline.functions import lexemes as lx
from citeline.operators import term_index

CASES = {
    "Press turn-off, then E-18 or F5.": ["press", "turn-off", "turn", "off", "then", "e", "-18", "or", "f5"],
    "1.5 mm, -2 C, +7, -0.25e3 and 10-20": ["1.5", "mm", "-2", "c", "+7", "-0.25e3", "and", "10", "-20"],
    "firmware 8.3.0": ["firmware", "8.3.0"],
    "see a.b/c": ["see", "a.b/c", "a.b", "/c"],
    "http://help.acme-shop.com:80/E18?x=1 now": [
        "help.acme-shop.com:80/e18?x=1", "help.acme-shop.com:80", "/e18?x=1", "now",
    ],
    "mail Ann.Lee+x@acme-shop.com or help.acme.com": ["mail", "ann.lee+x@acme-shop.com", "or", "help.acme.com"],
    "foo_bar über-groß beta-1a": ["foo", "bar", "über-groß", "über", "groß", "beta-1a", "beta", "1a"],
    "": [],
    " -- / . @ ": [],
    None: None,
}


def test_kinds(spark):
    rows = spark.createDataFrame([(t,) for t in CASES], "text string")
    found = {r["text"]: r["tokens"] for r in rows.select("text", lx.lexemes(F.col("text")).alias("tokens")).collect()}
    assert found == CASES


def test_vector_lists_positions(spark):
    rows = spark.createDataFrame([("b a b turn-off a off",), ("",), (None,)], "text string")
    shown = [r[0] for r in rows.select(lx.vector(lx.lexemes(F.col("text")))).collect()]
    assert shown == ["a:2,7 b:1,3 off:6,8 turn:5 turn-off:4", "", None]


def test_index_by_other_tokens_finds_codes(spark, tmp_path):
    chunks = spark.createDataFrame(
        [(1, "Code E-18 means the pump is off."), (2, "Row 18 of the list, E as in east."), (3, "Use turn-off twice."), (4, None)],
        "chunk_id long, content string",
    )
    asked = spark.createDataFrame([(1, "what is E-18"), (2, "turn-off"), (3, "off")], "question_id long, question string")
    index = term_index.write_index(chunks, str(tmp_path / "index"), cut=lx.lexemes, cut_question=lx.query_lexemes)
    found = term_index.ranked(index, asked, score=term_index.bm25).collect()
    first = {r["question_id"]: r["chunk_id"] for r in found if r["rank"] == 1}
    assert first[1] == 1 and first[2] == 3
    assert {r["chunk_id"] for r in found if r["question_id"] == 3} == {1, 3}


@pytest.mark.parametrize("word", ["a-", "1.", "a.", "x@", "a/", "-1"])
def test_long_texts_take_time_in_proportion(spark, word):
    rows = spark.createDataFrame([(word * 100_000,)], "text string")
    started = time.time()
    assert rows.select(F.size(lx.lexemes(F.col("text")))).first()[0] >= 1
    assert time.time() - started < 20
