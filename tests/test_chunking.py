"""Chunking against a sequential splitter over whole, joined blocks."""

import random
import re
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from citeline.config import Settings
from citeline.operators import chunking, pages
from citeline.operators.splitting import SEPARATORS, split_spans
from citeline.session import settle


def sequential(text, size, overlap, separators=SEPARATORS):
    """Recursive packing done literally on strings: (offset, piece) lists."""

    def pack(parts):
        out, held = [], []
        for at, part in parts:
            total = sum(len(p) for _, p in held)
            if held and total + len(part) > size:
                out.append(held)
                held = list(held)
                while held and (total > overlap or total + len(part) > size):
                    total -= len(held.pop(0)[1])
            held.append((at, part))
        return out + ([held] if held else [])

    def cut(base, text, separators):
        sep = next(s for s in separators if s == "" or s in text)
        finer = separators[separators.index(sep) + 1 :]
        if sep == "":
            parts = list(text)
        else:
            head, *rest = re.split(f"({re.escape(sep)})", text)
            parts = [head] + [a + b for a, b in zip(rest[::2], rest[1::2])]
            parts = [p for p in parts if p]
        out, short, at = [], [], base
        for part in parts:
            if len(part) < size:
                short.append((at, part))
            else:
                out += pack(short)
                short = []
                out += cut(at, part, finer) if finer else [[(at, part)]]
            at += len(part)
        return out + pack(short)

    found = [(held[0][0], "".join(p for _, p in held)) for held in cut(0, text, separators)]
    return [(at, piece) for at, piece in found if piece.strip()]


def expected(doc, s):
    """(ordinal, page_from, page_to, language, section, content) of one document."""
    out = []
    for _, group in groupby(doc, key=lambda p: p[2]):
        block = list(group)
        offsets, cursor = [], 0
        for _, text, *_ in block:
            offsets.append(cursor)
            cursor += len(text) + 2
        joined = "\n\n".join(p[1] for p in block)
        for at, piece in sequential(joined, s.chunk_size, s.chunk_overlap):
            start = at + len(piece) - len(piece.lstrip())
            end = at + len(piece.rstrip())
            first = [p[0] for p, o in zip(block, offsets) if o <= start][-1]
            last = [p[0] for p, o in zip(block, offsets) if o < end][-1]
            out.append((len(out), first, last, block[0][2], block[0][3], piece.strip()))
    return out


def sentence(rng, n):
    words = ["filter", "clean", "E5", "door", "press", "the", "a", "mode", "hold"]
    text = " ".join(rng.choice(words) for _ in range(n))
    return text + rng.choice([".", ";", ",", ""])


def random_doc(rng, n_pages, longest):
    doc, page = [], 0
    for _ in range(n_pages):
        page += rng.choice([1, 1, 1, 2])
        lines = [
            " ".join(sentence(rng, rng.randint(1, 9)) for _ in range(rng.randint(1, 4)))
            for _ in range(rng.randint(1, longest))
        ]
        text = rng.choice(["\n", "\n", " "]).join(lines)
        if rng.random() < 0.1:
            text = "x" * rng.randint(1, 500)
        if rng.random() < 0.2:
            text += "\n\n" + sentence(rng, 30)
        language = rng.choice(["en"] * 5 + ["es"])
        doc.append((page, text, language, rng.choice([None, "Safety"])))
    return doc


def run(spark, docs, s):
    rows = [(d, p, t, lang, sec, len(t)) for d, doc in docs.items() for p, t, lang, sec in doc]
    df = spark.createDataFrame(
        rows, "doc_id string, page int, text string, language string, section string, chars int"
    )
    blocks = pages.language_blocks(df.drop("text"), s=s)
    labelled = df.join(blocks.select("doc_id", "page", "block", "offset"), ["doc_id", "page"])
    got = {d: [] for d in docs}
    for r in chunking.chunk_pages(settle(labelled), s).orderBy("doc_id", "ordinal").collect():
        got[r.doc_id].append(
            (r.ordinal, r.page_from, r.page_to, r.language, r.section, r.content)
        )
    return got


@pytest.mark.parametrize("size,overlap", [(100, 10), (200, 20), (1200, 150)])
def test_chunks_match_sequential_splitting(spark, size, overlap):
    s = Settings(chunk_size=size, chunk_overlap=overlap, order_bucket=5)
    rng = random.Random(size)
    docs = {f"d{i}": random_doc(rng, rng.randint(1, 25), 6) for i in range(12)}
    got = run(spark, docs, s)
    for d, doc in docs.items():
        assert got[d] == expected(doc, s), d


def test_parts_of_one_long_run_are_linked(spark, monkeypatch):
    """A document far longer than a part packs as if it were read in one go."""
    monkeypatch.setattr(chunking, "PART_CHARS", 700)
    s = Settings(chunk_size=200, chunk_overlap=60, order_bucket=7)
    rng = random.Random(3)
    docs = {"even": [(i + 1, "y" * 40, "en", None) for i in range(150)]}
    for i in range(4):
        docs[f"r{i}"] = [
            (p + 1, "z" * rng.randint(1, 110), "en", None) for p in range(rng.randint(20, 120))
        ]
    got = run(spark, docs, s)
    for d, doc in docs.items():
        assert got[d] == expected(doc, s), d


def test_contract(spark):
    s = Settings(chunk_size=200, chunk_overlap=60)
    text = " ".join(["word"] * 400)
    got = run(spark, {"a": [(34, text, "en", None)], "b": [(7, "short page", "en", "S"), (8, "next", "en", "T")]}, s)
    a = got["a"]
    assert [c[0] for c in a] == list(range(len(a)))
    assert all(len(c[5]) <= 260 for c in a) and all(c[1] == c[2] == 34 for c in a)
    assert got["b"] == [(0, 7, 8, "en", "S", "short page\n\nnext")]


def test_spans_cover_text():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab .,;\n") for _ in range(rng.randint(1, 400)))
        spans = split_spans(text, 40, 10)
        assert [(a, text[a:b]) for a, b in spans if text[a:b].strip()] == sequential(text, 40, 10)


def test_columns_are_pruned_from_block_work(spark):
    df = spark.range(1).select(
        F.lit("d").alias("doc_id"), F.lit(1).alias("page"), F.lit("en").alias("language"),
        F.lit(10).alias("chars"),
    )
    assert "text" not in pages.language_blocks(df).columns
