"""Where to cut a text: separators in order, pieces packed up to a size.

All positions are character offsets; nothing here copies text.
"""

import numpy as np

# Separators from coarse to fine; a piece keeps the separator it
# starts with. The empty one cuts between any two characters.
SEPARATORS = ("\n\n", "\n", ". ", "; ", ", ", " ", "")


def packing(starts: np.ndarray, end: int, size: int, overlap: int):
    """Pack contiguous pieces greedily.

    Piece i runs from ``starts[i]`` to the next start (the last one to
    ``end``). Returns, for a chunk that starts at piece i, the piece it stops
    before and the piece the next chunk starts at: as far back as the overlap
    allows while the piece that did not fit still does. Both depend on i
    alone, so a long row of pieces can be packed in parts (see ``chunking``).
    """
    edges = np.append(starts, end)
    n = len(starts)
    stop = np.searchsorted(edges, starts + size, side="right") - 1
    cut = np.minimum(stop, n - 1)
    least = np.maximum(edges[cut] - overlap, edges[cut + 1] - size)
    follow = np.minimum(np.searchsorted(edges, least, side="left"), cut)
    return stop, np.where(stop < n, follow, n)


def walk(starts: np.ndarray, end: int, size: int, overlap: int, first: int = 0):
    """(piece, stop) of every chunk from piece ``first`` on."""
    stop, follow = packing(starts, end, size, overlap)
    out, at = [], first
    while at < len(starts):
        out.append((at, int(stop[at])))
        at = int(follow[at])
    return out


def _cuts(text: str, lo: int, hi: int, separator: str) -> np.ndarray:
    if separator == "":
        return np.arange(lo, hi)
    starts, at = [lo], text.find(separator, lo, hi)
    while at != -1:
        if at > lo:
            starts.append(at)
        at = text.find(separator, at + len(separator), hi)
    return np.array(starts)


def split_spans(
    text: str, size: int, overlap: int, separators=SEPARATORS, lo: int = 0, hi: int | None = None
) -> list[tuple[int, int]]:
    """Spans of the chunks of one text. A piece that is too long on its own is
    cut by the finer separators, and packing starts afresh after it."""
    hi = len(text) if hi is None else hi
    if hi <= lo:
        return []
    level = next(i for i, s in enumerate(separators) if s == "" or text.find(s, lo, hi) != -1)
    finer = separators[level + 1 :]
    starts = _cuts(text, lo, hi, separators[level])
    edges = np.append(starts, hi)
    long = np.diff(edges) >= size
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(starts):
        if long[at]:
            if finer:
                out += split_spans(text, size, overlap, finer, int(edges[at]), int(edges[at + 1]))
            else:
                out.append((int(edges[at]), int(edges[at + 1])))
            at += 1
            continue
        later = np.flatnonzero(long[at:])
        to = at + int(later[0]) if len(later) else len(starts)
        for a, b in walk(starts[at:to], int(edges[to]), size, overlap):
            out.append((int(edges[at + a]), int(edges[at + b])))
        at = to
    return out
