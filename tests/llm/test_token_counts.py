import random

import pyarrow as pa
import pytest

from citeline.llm import token_counts as C
from citeline.llm import words as W
from tests.llm.helpers import table

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, tokens string"
PARTS = [
    " ", "  ", "\n", "\t", "a", "bc", "é", " ", "　", " ", "'s", "'", '"', "1", "23", "!",
    "<|endoftext|>", "中", "\u0085", "я", "ß", "  a", "​", "İ", "\x1c", "�", "😀",
]


def expected(texts, name="byte_bpe_50k.json"):
    library = tokenizers.Tokenizer.from_file(C.file_path(name))
    library.no_truncation()
    return [len(e) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_are_those_of_the_library(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [None, "", " ", "word " * 30_000, "x" * 5000, "a b" * 5000]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    counted = C.count_tokens(table(spark, rows, DOCS))
    assert counted.columns == ["doc_id", "text", "tokens"]
    found = {r[0]: tuple(r)[1:] for r in C.digest(counted).collect()}
    want = expected(texts)
    for i, t in enumerate(texts):
        assert found[i] == (len((t or "").encode()), want[i], want[i] > C.LIMIT), t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_files_without_safe_boundaries_are_encoded_whole(name):
    texts = ["Hello  world", "", "a\n b", "hello hello"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    counter = C.Counter(name)
    assert not counter.cuts
    (_, data, offsets), *_ = W.units(batch, "text")
    found = [x["n_tokens"] for x in counter(data, offsets).to_pylist()]
    if name.endswith(".json"):
        assert found == expected(texts, name)
    else:
        sentencepiece = pytest.importorskip("sentencepiece")
        model = sentencepiece.SentencePieceProcessor(model_file=C.file_path(name))
        assert found == [len(model.encode(t)) for t in texts]


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr(C, "REMEMBERED", 5)
    counter = C.Counter("byte_bpe_50k.json")
    for i in range(4):
        text = " ".join(f"w{i}x{j}" for j in range(20))
        batch = pa.RecordBatch.from_pydict({"text": [text]})
        (_, data, offsets), *_ = W.units(batch, "text")
        assert counter(data, offsets).to_pylist()[0]["n_tokens"] == expected([text])[0]
        assert len(counter.known) <= 25


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, None, None)]
    assert sorted(map(str, C.digest(C.count_tokens(table(spark, rows, DOCS))).collect())) == sorted(
        ["Row(doc_id=1, n_bytes=7, n_tokens=2, over_limit=False)"] * 2
        + ["Row(doc_id=None, n_bytes=0, n_tokens=0, over_limit=False)"]
    )
    assert C.count_tokens(spark.createDataFrame([], DOCS)).count() == 0
