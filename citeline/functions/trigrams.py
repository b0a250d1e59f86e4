"""Character trigrams as hashed features, for many texts at once inside Arrow tasks.

The features are those of MLlib's RegexTokenizer (no separator), NGram and
HashingTF: the trigram's characters joined by spaces, MurmurHash3 of the bytes
with seed 42. A character beyond the basic plane is two question marks there.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

FEATURES = 1 << 14
#: Trigrams that one numpy pass works on.
PART = 1 << 18


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint32(by)) | (x >> np.uint32(32 - by))


def _scrambled(word: np.ndarray) -> np.ndarray:
    return _turned(word * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)


def hashed(keys: np.ndarray, features: int = FEATURES) -> np.ndarray:
    """Feature of each trigram, given as three characters of 16 bits in a number."""
    chars = np.stack([(keys >> 32) & 0xFFFF, (keys >> 16) & 0xFFFF, keys & 0xFFFF])
    rows, at = np.arange(len(keys)), np.zeros(len(keys), dtype=np.int64)
    text = np.zeros((len(keys), 12), dtype=np.uint8)
    for i, c in enumerate(chars):
        one, two = c < 0x80, (c >= 0x80) & (c < 0x800)
        text[rows, at] = np.where(one, c, np.where(two, 0xC0 | c >> 6, 0xE0 | c >> 12))
        more = ~one
        text[rows[more], at[more] + 1] = 0x80 | (np.where(two, c, c >> 6) & 0x3F)[more]
        more = more & ~two
        text[rows[more], at[more] + 2] = 0x80 | c[more] & 0x3F
        at += np.where(one, 1, np.where(two, 2, 3))
        if i < 2:
            text[rows, at] = 32
            at += 1
    words = text.view("<u4")
    out = np.full(len(keys), 42, dtype=np.uint32)
    for i in range(3):
        word = _scrambled(words[:, i])
        whole = _turned(out ^ word, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        out = np.where(at >= 4 * i + 4, whole, np.where(at > 4 * i, out ^ word, out))
    out ^= at.astype(np.uint32)
    out = (out ^ (out >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    out = (out ^ (out >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    out ^= out >> np.uint32(16)
    return out.view(np.int32).astype(np.int64) % features


def hashed_trigrams(texts: pa.Array, features: int = FEATURES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of all trigrams of some lower-cased texts, in parts of bounded
    size. A null or shorter text has none."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), dtype="<u4")
    row = np.repeat(np.arange(len(texts)), sizes)
    wide = points > 0xFFFF
    if wide.any():
        points, row = (np.repeat(x, 1 + wide) for x in (np.where(wide, ord("?"), points), row))
    for a in range(0, len(points) - 2, PART):
        b = min(len(points) - 2, a + PART)
        first, second, third = (points[a + i : b + i].astype(np.int64) for i in range(3))
        inside = row[a:b] == row[a + 2 : b + 2]
        keys, place = np.unique((first << 32 | second << 16 | third)[inside], return_inverse=True)
        yield row[a:b][inside], hashed(keys, features)[place]
