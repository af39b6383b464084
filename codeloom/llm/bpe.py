"""Byte-pair encoding by a public vocabulary of ranks, in plain Python, for use inside Arrow batches."""

from __future__ import annotations

import base64
import heapq

import regex

#: how byte-level BPE of the GPT-2 family parts a text into words (fixed value)
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: words of more bytes than this are merged with a heap, as scanning them again and again takes quadratic time
SHORT = 256


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank from the text of a .tiktoken file."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: an array of part boundaries beside one of the ranks of adjacent pairs; the least rank is looked
    for by scanning, its boundary is deleted, and the ranks of the two neighbouring pairs are looked up again."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    none = 1 << 60
    n = len(word)
    bounds = list(range(n + 1))
    get = ranks.get
    pair = [get(word[i : i + 2], none) for i in range(n - 1)]
    while pair:
        least = min(pair)
        if least == none:
            break
        i = pair.index(least)
        del bounds[i + 1]
        del pair[i]
        if i < len(pair):
            pair[i] = get(word[bounds[i] : bounds[i + 2]], none)
        if i:
            pair[i - 1] = get(word[bounds[i - 1] : bounds[i + 1]], none)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same ids as merge_short, in n log n: a heap of pairs over a linked list of parts."""
    n = len(word)
    after, before, end, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = False
        end[i] = stop
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(word[i : end[k]])) is not None:
                heapq.heappush(heap, (r, i, end[k]))
        h = before[i]
        if h >= 0 and (r := ranks.get(word[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    return [ranks[word[i : end[i]]] for i in range(n) if alive[i]]


class Encoder:
    """Encodes texts; the ids of words met before are kept, up to a fixed number of words."""

    KEPT = 200_000
    KEPT_BYTES = 64

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.parts = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        data = w.encode("utf-8", "replace")
        ids = merge_short(data, self.ranks) if len(data) <= SHORT else merge_long(data, self.ranks)
        if len(data) <= self.KEPT_BYTES:
            if len(self.known) >= self.KEPT:
                self.known.clear()
            self.known[w] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; null and the empty text have none. Text that looks like a special token is plain text."""
        out: list[int] = []
        if text:
            known, word, extend = self.known.get, self.word, out.extend
            for w in self.parts(text):
                extend(known(w) or word(w))
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, word = self.known.get, self.word
        return sum([len(known(w) or word(w)) for w in self.parts(text)])
