"""Words of many texts at once, as numpy arrays, inside Arrow tasks.

A batch of texts stays one byte buffer. Words are found by passes over that
buffer, so the cost per byte is a few machine operations; memory is bounded
because texts are taken in units of at most ``UNIT`` bytes, or one text. Within
a unit words are told apart by their bytes (``Words.codes``); across units they
are named by the XXH64 of their bytes, made once for each different word.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from citeline.functions.arrow import bounded_batches  # noqa: F401

#: Bytes of text that one numpy pass works on.
UNIT = 1 << 20

_SEED = 0x9E3779B97F4A7C15
_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def alphabet(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, the byte it stands for) by byte value."""
    inside = np.ones(256, dtype=bool)
    inside[list(separators)] = False
    stands = np.arange(256, dtype=np.uint8)
    if lower:
        stands[ord("A") : ord("Z") + 1] += 32
    return inside, stands


#: Words between the separators \x20 and \x09-\x0D, as they are and with A-Z lower-cased.
SPACED = alphabet(b"\x20\x09\x0a\x0b\x0c\x0d", False)
SPACED_LOWER = alphabet(b"\x20\x09\x0a\x0b\x0c\x0d", True)
#: Runs of digits, letters and anything beyond ASCII, lower-cased.
LETTERS_LOWER = alphabet(
    bytes(b for b in range(128) if not (48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123)), True
)


@dataclass
class Words:
    """Words of some texts, in order: bytes [start, end) of ``data``, which has
    been mapped by the alphabet; ``first[i]`` .. ``first[i + 1]`` belong to text i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    @cached_property
    def codes(self) -> tuple[np.ndarray, pa.Array]:
        """(a number per word, the words by number): equal words have equal numbers."""
        size = self.end - self.start
        to = np.cumsum(size)
        at = np.zeros(len(size) + 1, dtype=np.int64)
        at[1:] = to
        packed = self.data[self._inside()]
        held = pa.Array.from_buffers(
            pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(packed))]
        ).dictionary_encode()
        return held.indices.to_numpy(zero_copy_only=False).astype(np.int64), held.dictionary

    @cached_property
    def names(self) -> np.ndarray:
        """XXH64 of the different words, by number."""
        data, offsets = buffers(self.codes[1])
        raw, at = data.tobytes(), offsets.tolist()
        digests = b"".join([xxhash.xxh64_digest(raw[a:b], _SEED) for a, b in zip(at[:-1], at[1:], strict=True)])
        return np.frombuffer(digests, dtype=">u8").astype(np.uint64)

    @cached_property
    def hash(self) -> np.ndarray:
        """XXH64 of each word."""
        return self.names[self.codes[0]]

    def _inside(self) -> np.ndarray:
        """Which bytes belong to a word."""
        change = np.zeros(len(self.data) + 1, dtype=np.int8)
        change[self.start] = 1
        change[self.end] -= 1
        return np.cumsum(change[:-1], dtype=np.int8).astype(bool)

    def owner(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All words joined by one space, and each word's place there."""
        size = self.end - self.start
        to = np.cumsum(size + 1) - 1
        at = to - size
        out = np.full(int(to[-1]) if len(to) else 0, 32, dtype=np.uint8)
        place = np.ones(len(out), dtype=bool)
        place[to[:-1]] = False
        out[place] = self.data[self._inside()]
        return out.tobytes(), at, to


def split(data: np.ndarray, offsets: np.ndarray, letters: tuple[np.ndarray, np.ndarray]) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]."""
    inside, stands = letters[0][data], letters[1][data]
    n = len(data)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    opens[cuts] = inside[cuts]
    closes = np.zeros(n + 1, dtype=bool)
    closes[1:n] = inside[:-1] & ~inside[1:]
    if n:
        closes[n] = inside[-1]
        closes[cuts] |= inside[cuts - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes)
    first = np.searchsorted(start, offsets, side="left")
    return Words(stands, offsets, start, end, first)


def rolling(hashes: np.ndarray, k: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each run of k consecutive word hashes (len - k + 1 of them)."""
    n = len(hashes)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n - k + 1, dtype=np.uint64)
    multiply = np.uint64(base | 1)
    for i in range(k) if k <= 8 else ():
        out = out * multiply + hashes[i : n - k + 1 + i]
    if k > 8:
        inverse = np.uint64(pow(int(multiply), -1, 1 << 64))
        for low in range(0, n - k + 1, UNIT):
            high = min(n - k + 1, low + UNIT)
            part = hashes[low : high + k - 1]
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(part * powers(multiply, len(part)), out=sums[1:])
            out[low:high] = (sums[k:] - sums[:-k]) * powers(inverse, high - low)
    return mix(out)


def inside_one(words: Words, k: int) -> np.ndarray:
    """Which runs of k consecutive words lie within one text."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=bool)
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(len(words))
    return left[:n] >= k


def per_text(values: np.ndarray, first: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sums of ``values`` (one per word) by text."""
    sums = np.zeros(len(values) + 1, dtype=dtype)
    np.cumsum(values, out=sums[1:], dtype=dtype)
    return sums[first[1:]] - sums[first[:-1]]


def covered(n: int, start: np.ndarray, length) -> np.ndarray:
    """Which of n positions lie in any of the runs start .. start + length - 1."""
    change = np.zeros(n + 1, dtype=np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:n]) > 0


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary Arrow array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, held = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offsets = np.frombuffer(at, dtype=kind)[column.offset : column.offset + len(column) + 1]
    offsets = offsets.astype(np.int64)
    if held is None:
        return np.empty(0, dtype=np.uint8), offsets - offsets[0]
    data = np.frombuffer(held, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def units(
    batch: pa.RecordBatch, text: str, most: int | None = None
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with at most ``most`` bytes of text (``UNIT``), or one row
    each: (rows, bytes of their texts, offsets)."""
    most = most or UNIT
    data, offsets = buffers(batch.column(text))
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
