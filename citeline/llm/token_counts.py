"""Token counts of whole texts by a given tokenizer file.

Texts are encoded by the library in batches inside Arrow tasks; only lengths
come back. A batch holds about ``words.UNIT`` bytes of text. Before encoding,
texts are cut at safe boundaries: in front of a single space between two
characters that are no white space, where the pre-tokenizer of a byte-level
BPE always begins a new token, whatever stands before or after. Equal parts of
a batch are encoded once and counted as often as they occur. Where a file's
pre-tokenizer is not known to begin tokens there, whole texts are encoded.
"""

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm import words as W
from citeline.llm.columns import add_struct

#: Parts whose lengths a worker remembers; beyond that it starts afresh.
REMEMBERED = 400_000
#: Tokens above which a text counts as over the limit.
LIMIT = 512
RESULT = "struct<n_bytes:bigint,n_tokens:bigint>"


def file_path(tokenizer: str) -> str:
    """The place of a vocabulary file: a path, or a name known to the installed set."""
    if "/" in tokenizer:
        return tokenizer
    import public_tokenizers

    return public_tokenizers.path(tokenizer)


def safe_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions, text starts included, where a part may begin.

    A space counts when the characters next to it are surely no white space: a
    printable ASCII character, or bytes of a longer character whose lead byte
    is not one under which Unicode has white space (C2, E1, E2, E3).
    """
    n = len(data)
    wide = np.zeros(256, dtype=bool)
    wide[[0xC2, 0xE1, 0xE2, 0xE3]] = True
    solid = np.zeros(256, dtype=bool)
    solid[0x21:0x7F] = True
    solid[0x80:] = True
    at = np.flatnonzero(data == 32)
    at = at[(at > 2) & (at < n - 1)]
    before, after = data[at - 1], data[at + 1]
    good = solid[before] & solid[after] & ~wide[after]
    good &= (before < 0x80) | ~(wide[data[at - 2]] | wide[data[at - 3]])
    starts = offsets[:-1]
    at = at[good]
    at = at[~np.isin(at + 1, starts)]
    return np.union1d(starts[starts < n], at)


class Counter:
    """Counts tokens with the library that a vocabulary file belongs to."""

    def __init__(self, tokenizer: str):
        self.known: dict[bytes, int] = {}
        path = file_path(tokenizer)
        if path.endswith(".json"):
            # a task has one core: the library must not start threads of its own
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            with open(path) as file:
                spec = json.load(file)
            before = spec.get("pre_tokenizer") or {}
            self.cuts = (
                spec.get("normalizer") is None
                and before.get("type") == "ByteLevel"
                and not before.get("add_prefix_space")
                and before.get("use_regex", True)
                and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"]
                            for x in spec.get("added_tokens", []))
            )
            library = Tokenizer.from_file(path)
            library.no_truncation()
            library.no_padding()
            self.lengths = lambda texts: [
                len(x) for x in library.encode_batch_fast(texts, add_special_tokens=False)
            ]
        else:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=path)
            self.cuts = False
            self.lengths = lambda texts: [len(x) for x in library.encode(texts, num_threads=1)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        sizes = np.diff(offsets)
        cuts = safe_cuts(data, offsets) if self.cuts else np.unique(offsets[:-1][sizes > 0])
        raw, ends = data.tobytes(), np.append(cuts[1:], len(data))[: len(cuts)]
        parts = [raw[a:b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        fresh = [x for x in dict.fromkeys(parts) if x not in known]
        known.update(zip(fresh, self.lengths([x.decode() for x in fresh]), strict=True))
        counts = np.array([known[x] for x in parts], dtype=np.int64)
        if not self.cuts:
            self.known = {}
        first = np.searchsorted(cuts, offsets, side="left")
        return pa.StructArray.from_arrays(
            [pa.array(sizes), pa.array(W.per_text(counts, first))], names=["n_bytes", "n_tokens"]
        )


_counters: dict[str, Counter] = {}


def counter(tokenizer: str) -> Counter:
    """The counter of a file, made once per worker."""
    if tokenizer not in _counters:
        _counters[tokenizer] = Counter(tokenizer)
    return _counters[tokenizer]


def count_tokens(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", into: str = "tokens"
) -> DataFrame:
    """``docs`` with a struct ``into``: n_bytes (UTF-8) and n_tokens of the whole text.

    A null text counts as empty, and an empty text has no tokens. Repeated rows
    each get their counts; a column called ``into`` is replaced, others pass.
    """
    return add_struct(docs, text, into, RESULT, lambda: counter(tokenizer))


def digest(counted: DataFrame, doc_id: str = "doc_id", limit: int = LIMIT, into: str = "tokens") -> DataFrame:
    """One row per document with its counts and whether it is over the limit."""
    n = F.col(f"`{into}`.n_tokens")
    return counted.select(
        doc_id, F.col(f"`{into}`.n_bytes").alias("n_bytes"), n.alias("n_tokens"), (n > limit).alias("over_limit")
    )
