"""Word windows of many texts at once, and the blocks they fall into.

A window is ``width`` consecutive words. Its representative is the word 8-gram in it with the least hash (the leftmost
of equals): equal windows have equal representatives, and a run of neighbouring windows mostly shares one. A block is
such a run; one block stands for about twenty windows, so tables of blocks are far smaller than tables of windows.

Representatives and contexts are 64-bit hashes (a word's XXH64, and the polynomial over its words' hashes for a stretch):
they say where to look. What is equal is said by 128 bits (XXH3) of the words themselves. ``bits`` weakens words' hashes,
for tests.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import xxhash

GRAM = 8
WORDS_AT_ONCE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def words_of(text: str | None) -> list[bytes]:
    """bytes.split() divides at the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").split()


@dataclass(frozen=True)
class Blocks:
    """One entry per block: which text, its first window's start, number of windows, representative, hash of all its words."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    first: np.ndarray  # where the block's windows begin in ``place``
    place: np.ndarray  # of every window, where its words begin in ``words``
    words: list[bytes]

    def keys(self, at: np.ndarray, width: int) -> np.ndarray:
        """128-bit hashes of the words of these blocks, as two numbers each."""
        start = self.place[self.first[at]]
        return word_keys(self.words, start, start + self.count[at] - 1 + width)

    def window_keys(self, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """How many windows each of these blocks has, and the same of all of them."""
        sizes = self.count[at]
        start = self.place[np.repeat(self.first[at] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())]
        return sizes, word_keys(self.words, start, start + width)


def word_keys(words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    found = [xxhash.xxh3_128_digest(b" ".join(words[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.frombuffer(b"".join(found), dtype=">i8").astype(np.int64).reshape(-1, 2)


def _blocks(words: list[bytes], bits: int, lengths: np.ndarray, width: int, text0: int, start0: int) -> Blocks | None:
    """``words``: those of one or more texts in a row; text numbers count from text0, starts from start0."""
    n = len(words)
    if n < width:
        return None
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n) & np.uint64((1 << bits) - 1)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    start = np.arange(n) - (ends - lengths)[text]
    gram = np.zeros(n - GRAM + 1, dtype=np.uint64)
    for j in range(GRAM):
        gram = gram * np.uint64(_BASE) + h[j : n - GRAM + 1 + j]
    gram = mixed(gram)
    at = np.flatnonzero(start[: n - width + 1] + width <= lengths[text[: n - width + 1]])
    if not len(at):
        return None
    span = width - GRAM + 1
    views = np.lib.stride_tricks.sliding_window_view(gram, span)
    least = np.concatenate([views[i : i + 16_384].argmin(axis=1) for i in range(0, len(views), 16_384)])[at] + at
    new = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[at[1:]] != text[at[:-1]])])
    count = np.diff(np.r_[new, len(at)])
    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, WORDS_AT_ONCE * 2)[:n], dtype=np.uint64)]
    back = _powers(_INVERSE, WORDS_AT_ONCE * 2)
    stretch = lambda a, b: mixed((sums[b] - sums[a]) * back[a])
    first = at[new]
    return Blocks(text[first] + text0, start[first] + start0, count, gram[least[new]], stretch(first, first + count - 1 + width), new, at, words)


def blocks_of(texts: Iterable[list[bytes]], width: int, bits: int = 64) -> Iterator[Blocks]:
    """Blocks of all texts, in groups of about WORDS_AT_ONCE words; a longer text comes in overlapping parts.

    No more than one group's words are held at a time.

    A part's windows are exactly those that start in it, so every window is in one block; a run of windows that a part's
    end divides is two blocks here and there, which costs selectivity at such places, never a window.
    """
    held: list[list[bytes]] = []
    size = first = 0

    def flush(until: int):
        nonlocal held, size, first
        if held and (found := _blocks([w for t in held for w in t], bits, np.array([len(t) for t in held]), width, first, 0)):
            yield found
        held, size, first = [], 0, until

    i = -1
    for i, words in enumerate(texts):
        if len(words) > WORDS_AT_ONCE:
            yield from flush(i + 1)
            for a in range(0, len(words) - width + 1, WORDS_AT_ONCE):
                part = words[a : a + WORDS_AT_ONCE + width - 1]
                if found := _blocks(part, bits, np.array([len(part)]), width, i, a):
                    yield found
            continue
        if size + len(words) > WORDS_AT_ONCE:
            yield from flush(i)
        held.append(words)
        size += len(words)
    yield from flush(i + 1)
