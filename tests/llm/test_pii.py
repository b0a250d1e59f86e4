import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from citeline.llm import pii
from tests.llm.helpers import table

DOCS = "doc_id long, text string, pii string"


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[ -]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    out.sort()
    spans = ",".join(f"{k}:{s}:{e}" for s, _, k, e in out)
    return *(sum(o[2] == k for o in out) for k in ("email", "ip", "card", "phone")), hashlib.sha256(spans.encode()).hexdigest()


def got(spark, rows):
    return {r[0]: tuple(r)[1:] for r in pii.digest(pii.find(table(spark, rows, DOCS))).collect()}


def test_base_spans_match_the_patterns(spark):
    rng = random.Random(3)
    parts = [
        "a@b.c", "@", ".", "1.2.3.4", "255", "256.", "4111 1111 1111 1111", " ", "-", "+49 (0) 30 12345-678",
        "+", "é", "😀", "x.y@z-1.co.uk", "\n", "0001", "a_b@c.d_e@f.g", "5500-0000-0000-0004",
    ]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))), "x") for i in range(1500)]
    rows += [(5000, None, None), (5001, "", "x"), (5002, "a@b.c " * 700, "x"), (5003, "1." * 3000, "x")]
    found = got(spark, rows)
    for doc, text, _ in rows:
        assert found[doc][:5] == base(text), text


def test_validators_and_context(spark):
    rows = [
        (1, "pay to GB82 WEST 1234 5698 7654 32 now", ""),
        (2, "pay to GB82 WEST 1234 5698 7654 33 now", ""),
        (3, "my ssn is 123-45-6789", ""),
        (4, "part number 123-45-6789", ""),
        (5, "ssn 000-45-6789 ssn 123-00-6789 ssn 666-12-1234", ""),
        (6, "call 4111 1111 1111 1111", ""),
    ]
    found = got(spark, rows)
    assert found[1][5] == "iban:7:34"
    assert found[2][5] == ""
    assert found[3][5] == "national_id:10:21"
    assert found[4][5] == "" and found[5][5] == ""
    assert found[6][5] == "card:5:24"
    scores = {
        r["doc_id"]: r["pii"][0]["score"]
        for r in pii.find(table(spark, [(1, "card 4111111111111111", ""), (2, "4111111111111111", "")], DOCS)).collect()
    }
    assert scores[1] > scores[2]


def test_redaction_and_other_columns(spark):
    rows = [(1, "é mail a@b.co or 10.0.0.1 é", "x"), (2, "none", "y"), (3, None, None), (4, "z" * 2500 + " a@b.co", "x")]
    docs = table(spark, rows, "doc_id long, text string, n_email string")
    found = pii.find(docs)
    assert found.columns == ["doc_id", "text", "n_email", "pii"]
    out = {r[0]: r[1] for r in found.select("doc_id", pii.redacted(F.col("text"), F.col("pii"))).collect()}
    assert out == {1: "é mail [EMAIL] or [IP] é", 2: "none", 3: None, 4: "z" * 2500 + " [EMAIL]"}


@pytest.mark.parametrize("piece", ["a", "1", "a@b.c ", "1.", "+1.", "4 ", "12-"])
def test_long_texts_take_time_in_proportion(spark, piece):
    def took(n):
        rows = spark.range(1).select(F.col("id").alias("doc_id"), F.expr(f"repeat('{piece}', {n})").alias("text"))
        started = time.perf_counter()
        pii.digest(pii.find(rows)).collect()
        return time.perf_counter() - started

    took(1000)
    assert took(200_000) < 30


def test_overlapping_spans_go_together(spark):
    spans = [("email", 1, 4), ("ip", 3, 9), ("card", 5, 6), ("phone", 9, 10), ("email", 12, 13)]
    rows = [(1, "0123456789abcdef", [(k, a, b, 1.0) for k, a, b in spans]), (2, "x", []), (3, None, [])]
    kind = "doc_id long, text string, pii array<struct<kind:string,start:int,end:int,score:double>>"
    out = spark.createDataFrame(rows, kind).select("doc_id", pii.redacted(F.col("text"), F.col("pii")).alias("t")).collect()
    assert {r.doc_id: r.t for r in out} == {1: "0[EMAIL][PHONE]ab[EMAIL]def", 2: "x", 3: None}


def test_redaction_takes_time_in_proportion(spark):
    """Two hundred thousand addresses in one text."""
    rows = spark.range(1).select(F.expr("repeat('a@b.c ', 200000)").alias("text"))
    started = time.perf_counter()
    out = pii.find(rows).select(pii.redacted(F.col("text"), F.col("pii")).alias("t")).first().t
    assert out == "[EMAIL] " * 200_000
    assert time.perf_counter() - started < 30


def test_empty_table(spark):
    assert got(spark, []) == {}


def test_main_path_has_no_python(spark):
    plan = pii.digest(pii.find(table(spark, [(1, "a", "")], DOCS)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
