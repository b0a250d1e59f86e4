"""Common-prefix intervals of sorted strings, scanned with a stack.

Strings are kept as whole numbers, first byte lowest, so the prefix that two of
them share is read off the lowest bit in which they differ.
"""

from collections.abc import Iterator


def number(text: bytes) -> int:
    return int.from_bytes(text, "little")


def shared(a: int, b: int, most: int) -> int:
    """Bytes that two strings share from their first on, at most ``most``."""
    differ = a ^ b
    return min(most, ((differ & -differ).bit_length() - 1) >> 3) if differ else most


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, low, high) of the intervals low .. high - 1 of sorted strings that
    share ``depth`` >= ``least`` first bytes, and no longer interval does, inner
    ones first. lcp[i] is what strings i - 1 and i share; there are at least two
    strings in an interval."""
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else -1
        low = i - 1
        while stack and stack[-1][0] > depth:
            d, low = stack.pop()
            yield d, low, i
        if depth >= least and (not stack or stack[-1][0] < depth):
            stack.append((depth, low))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): the maximal repeats around one place each in some
    strings. All members share ``left`` bytes before the place and ``right`` from
    it on, ``length`` in all at least; not all share one more on either side.

    ``rights`` must be sorted. Every interval of their common prefixes is a
    right-maximal repeat of the place; among its members, sorted by what stands
    before the place (read backwards), every interval is one that differs in the
    byte to the left. Those that lie within one inner interval are longer to the
    right and come from there.
    """
    most = [len(x) for x in rights]
    right = [number(x) for x in rights]
    back = [x[::-1] for x in lefts]
    left = [number(x) for x in back]
    room = max(len(x) for x in lefts)
    lcp = [0] + [shared(right[i - 1], right[i], min(most[i - 1], most[i])) for i in range(1, len(right))]
    for depth, low, high in intervals(lcp, max(1, length - room)):
        members = sorted(range(low, high), key=back.__getitem__)
        same = [0]
        for a, b in zip(members[:-1], members[1:], strict=True):
            same.append(shared(left[a], left[b], min(len(back[a]), len(back[b]))))
        for before, i, j in intervals(same, max(0, length - depth)):
            own = members[i:j]
            a, b = min(own), max(own)
            if shared(right[a], right[b], min(most[a], most[b])) == depth:
                yield before, depth, own
