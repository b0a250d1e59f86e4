"""Statistics of whole texts, for rules and classifiers."""

import numpy as np
import pyarrow as pa

from citeline.llm import words as W

LINES = W.alphabet(b"\n", False)
_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_UPPER = np.isin(np.arange(256), list(range(65, 91)))
_LETTER = np.isin(np.arange(256) & ~32, list(range(65, 91)))
_DIGIT = np.isin(np.arange(256), list(range(48, 58)))
_PAIR = np.uint64(0x9E3779B97F4A7C15)

COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_chars",
    "n_upper",
    "n_letters",
    "n_digits",
    "n_bangs",
    "n_bars",
    "n_commas",
    "n_ends",
    "n_twins",
    "n_distinct",
    "n_capitals",
)


def _count(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.searchsorted(np.flatnonzero(mask), offsets))


def _again(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier key, equal to any other key) by position."""
    order = np.argsort(keys, kind="stable")
    same = np.diff(keys[order]) == 0
    later, other = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:][same]] = True
    other[order[1:][same]] = True
    other[order[:-1][same]] = True
    return later, other


def counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """``COUNTS`` of some texts, each an int64 array. A text without words has
    zeros (its characters are still counted)."""
    words = W.split(data, offsets, W.SPACED)
    owner, n = words.owner(), len(words)
    head = (data & 0xC0) != 0x80  # a byte that begins a character
    chars = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(head, out=chars[1:])
    out = {"n_words": np.diff(words.first)}
    out["word_chars"] = W.per_text(chars[words.end] - chars[words.start], words.first)
    out["n_chars"] = np.diff(chars[offsets])
    for name, mask in (
        ("n_symbols", _SYMBOLS[data]),
        ("n_upper", _UPPER[data]),
        ("n_letters", _LETTER[data]),
        ("n_digits", _DIGIT[data]),
        ("n_bangs", data == ord("!")),
        ("n_bars", data == ord("|")),
        ("n_commas", data == ord(",")),
    ):
        out[name] = _count(mask, offsets)
    lines = W.split(data, offsets, LINES)
    held = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line_owner = lines.owner()[held]
    number, distinct = lines.codes
    later, _ = _again(number[held] + line_owner * len(distinct))
    texts = len(offsets) - 1
    out["n_lines"] = np.bincount(line_owner, minlength=texts)
    out["n_dup_lines"] = np.bincount(line_owner[later], minlength=texts)
    runs = W.rolling(words.hash, 5)
    start = np.flatnonzero(W.inside_one(words, 5))
    _, other = _again(W.mix(runs[start] + owner[start].astype(np.uint64) * _PAIR))
    out["n_repeat_words"] = W.per_text(W.covered(n, start[other], 5), words.first)
    last = data[words.end - 1]
    out["n_ends"] = W.per_text(np.isin(last, list(b".!?")), words.first)
    number, distinct = words.codes
    twin = np.zeros(n, dtype=bool)
    if n > 1:
        twin[1:] = (number[1:] == number[:-1]) & (owner[1:] == owner[:-1])
    out["n_twins"] = W.per_text(twin, words.first)
    later, _ = _again(number + owner * len(distinct))
    out["n_distinct"] = W.per_text(~later, words.first)
    out["n_capitals"] = W.per_text(_UPPER[data[words.start]], words.first)
    return {name: np.asarray(out[name], dtype=np.int64) for name in COUNTS}


RATES = (
    "log_words",
    "word_length",
    "symbols",
    "dup_lines",
    "repeats",
    "upper",
    "digits",
    "bangs",
    "bars",
    "commas",
    "ends",
    "twins",
    "distinct",
    "capitals",
    "line_length",
)


def rates(c: dict[str, np.ndarray]) -> np.ndarray:
    """One row of ``RATES`` per text: finite for every text, empty ones too."""
    words = np.maximum(1, c["n_words"])
    size = np.log1p(c["n_words"])
    columns = {
        "log_words": size,
        "word_length": c["word_chars"] / words,
        "symbols": c["n_symbols"] / words,
        "dup_lines": c["n_dup_lines"] / np.maximum(1, c["n_lines"]),
        "repeats": c["n_repeat_words"] / words,
        "upper": c["n_upper"] / np.maximum(1, c["n_letters"]),
        "digits": c["n_digits"] / np.maximum(1, c["n_chars"]),
        "bangs": c["n_bangs"] / words,
        "bars": c["n_bars"] / words,
        "commas": c["n_commas"] / words,
        "ends": c["n_ends"] / words,
        "twins": c["n_twins"] / words,
        "distinct": np.log1p(c["n_distinct"]) / np.maximum(size, np.log(2)),
        "capitals": c["n_capitals"] / words,
        "line_length": np.log1p(c["n_words"] / np.maximum(1, c["n_lines"])),
    }
    return np.stack([columns[name] for name in RATES], axis=1).astype(np.float64)


COUNTS_KIND = "struct<" + ",".join(f"{name}:bigint" for name in COUNTS) + ">"


def counts_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    found = counts(data, offsets)
    return pa.StructArray.from_arrays([pa.array(found[name]) for name in COUNTS], names=list(COUNTS))


def counts_of(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts back from an Arrow column made by ``counts_array``."""
    return {name: column.field(name).to_numpy(zero_copy_only=False) for name in COUNTS}
