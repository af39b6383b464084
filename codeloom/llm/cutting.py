"""Cutting one text at natural boundaries into pieces under a size limit; plain Python over bytes and offsets."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np

#: strength of boundaries: between bytes of a character none, between characters 1, at a blank 2, then lines and symbols (fixed values)
CHARACTER, BLANK, LINE, EMPTY_LINE, SYMBOL, OUTER_SYMBOL = 1, 2, 3, 4, 5, 6


def line_starts(data: bytes) -> np.ndarray:
    """Offsets at which lines start, by line feed, with the text's end as the last entry."""
    at = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    if len(at) and at[-1] == len(data):
        at = at[:-1]
    return np.concatenate(([0], at, [len(data)])).astype(np.int64)


def boundaries(data: bytes, starts: np.ndarray, symbols: list[tuple[int, int]], first: int = 0, last: int | None = None) -> tuple[list[int], list[int]]:
    """Sorted offsets of line starts within [first, last] and the strength of each as a boundary.

    symbols: (start_line, end_line), from 1; a place where a symbol starts or the one before ended is stronger than a
    line, and stronger still if no other symbol spans it. Lines that the text doesn't have are left out.
    """
    last = len(data) if last is None else last
    lo, hi = int(np.searchsorted(starts, first, "right")), int(np.searchsorted(starts, last, "left"))
    places = starts[lo:hi]
    strength = {}
    n = len(starts) - 1
    span = np.zeros(n + 2, dtype=np.int32)  # symbols that span the boundary before line i (from 0)
    edges = set()
    for a, b in symbols:
        if a is None or b is None or not 1 <= a <= b or a > n:
            continue
        b = min(b, n)
        edges.update((a - 1, b))
        if b > a:
            span[a] += 1
            span[b] -= 1
    open_ = np.cumsum(span)
    for k, at in enumerate(places):
        i = lo + k
        if i in edges:
            strength[int(at)] = OUTER_SYMBOL if open_[i] == 0 else SYMBOL
        else:
            before = data[starts[i - 1] : at]
            strength[int(at)] = EMPTY_LINE if not before.strip() else LINE
    return [int(x) for x in places], [strength[int(x)] for x in places]


def _character(data: bytes, at: int) -> int:
    """The next offset at or before `at` that is not inside a character."""
    while at > 0 and at < len(data) and (data[at] & 0xC0) == 0x80:
        at -= 1
    return at


def _overlap_start(data: bytes, places: list[int], floor: int, cut: int, overlap: int) -> int:
    """Where the piece after a cut starts: about `overlap` bytes before it, at a line if that is near enough."""
    want = cut - overlap
    if overlap <= 0:
        return cut
    if _character(data, max(want, 0)) <= floor:
        return cut  # the piece is no longer than the overlap
    i = bisect_right(places, want) - 1
    near = [p for p in (places[i] if i >= 0 else None, places[i + 1] if i + 1 < len(places) else None) if p is not None and floor < p < cut]
    near = [p for p in near if 0 < cut - p <= 2 * overlap and cut - p >= overlap // 2]
    return min(near, key=lambda p: abs(p - want)) if near else _character(data, want)


def cut(data: bytes, starts: np.ndarray, symbols: list[tuple[int, int]], limit: int, overlap: int, first: int = 0, last: int | None = None) -> list[tuple[int, int]]:
    """Ordered (start, end) offsets of pieces of data[first:last], each of at most `limit` bytes and not empty.

    The least number of pieces comes first; as many targets of equal length are placed, each is moved to the strongest
    boundary near it, and if a piece is then over the limit one more piece is tried. Consecutive pieces share about
    `overlap` bytes. Without a line start near a target the cut falls on a blank, else between two characters.
    """
    last = len(data) if last is None else last
    size = last - first
    if size <= limit:
        return [(first, last)] if size > 0 else []
    places, strength = boundaries(data, starts, symbols, first, last)
    step = limit - overlap
    pieces = max(2, -(-(size - overlap) // step))
    while True:
        target = size / pieces
        ends, at, ok, start = [], first, True, first
        out = []
        for k in range(1, pieces):
            goal = first + round(k * target)
            most = start + limit  # the piece from `start` may end here at the latest
            reach = max(64, int(target * 0.5))
            lo, hi = max(goal - reach, at + 1), min(goal + reach, most, last - 1)
            i, j = bisect_left(places, lo), bisect_right(places, hi)
            if i < j:
                best = max(range(i, j), key=lambda x: (strength[x] - 0.9 * abs(places[x] - goal) / reach, -places[x]))
                end = places[best]
            else:
                end = _blank_or_character(data, lo, min(goal, hi), hi)
            if end <= at or end - start > limit:
                ok = False
                break
            out.append((start, end))
            at = end
            start = _overlap_start(data, places, out[-1][0], end, overlap)
        if ok and last - start <= limit and last > at:
            out.append((start, last))
            return out
        pieces += 1
        if pieces > size:
            raise ValueError("limit and overlap leave no room for a piece")


def _blank_or_character(data: bytes, lo: int, goal: int, hi: int) -> int:
    if hi < lo:
        return -1
    window = data[lo:hi]
    at = max(window.rfind(b" ", 0, goal - lo), window.rfind(b"\t", 0, goal - lo))
    if at >= 0 and goal - (lo + at) < 200:
        return lo + at + 1
    got = _character(data, goal)
    return got if got >= lo else -1
