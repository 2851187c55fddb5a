"""Vectorised text primitives shared by the training-data operators.

Texts of an Arrow batch are laid end to end as one array of code points, so that
words, shingles and rolling hashes cost a handful of numpy passes per batch instead
of a Python call per word.  All hashes are 64 bit and depend on nothing but the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD6E8FEB86659FD93 | 1
_CHAR = U64(0xBF58476D1CE4E5B9)
_POWERS: dict[int, np.ndarray] = {}

#: A slice of a batch holds about so many characters; bounds the memory of the numpy passes.
SLICE_CHARS = 300_000


@lru_cache(1)
def word_table() -> np.ndarray:
    """True for every code point that is a letter or a digit."""
    table = np.zeros(0x110000, bool)
    for m in re.finditer(r"[^\W_]+", "".join(map(chr, range(0x110000)))):
        table[m.start() : m.end()] = True
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next batch."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_CHARS + 4096)
        steps = np.full(size, base % 2**64, U64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_hash(cp: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of (cp+1) * P**k over i <= k < j; see span_hash."""
    out = np.zeros(len(cp) + 1, U64)
    np.cumsum((cp.astype(U64) + U64(1)) * _CHAR * powers(_P, len(cp)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), the same wherever the span stands."""
    inverse = powers(pow(_P, -1, 2**64), len(prefix))
    return mix64((prefix[end] - prefix[start]) * inverse[start])


def slices(texts: Sequence[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit characters each; a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Words:
    """The words of several texts: hash, text number, and span in the joined text."""

    def __init__(self, texts: Sequence[str], fold: Callable[[str], str] = str.lower):
        folded = [fold(t) for t in texts]
        self.joined = "\n".join(folded) + "\n"
        cp = code_points(self.joined)
        isw = np.zeros(len(cp) + 1, np.int8)
        isw[1:] = word_table()[cp]
        step = np.diff(isw)
        self.start = np.flatnonzero(step == 1)
        self.end = np.flatnonzero(step == -1)
        if len(self.end) < len(self.start):
            self.end = np.append(self.end, len(cp))
        self.hash = span_hash(prefix_hash(cp), self.start, self.end)
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in folded], out=first[1:])
        #: bounds[i]:bounds[i+1] are the words of text i.
        self.bounds = np.searchsorted(self.start, first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words inside one text, and the number of their first word."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, U64), np.zeros(0, np.int64)
        total = np.zeros(count, U64)
        for j, p in enumerate(powers(_Q, n)):
            total += self.hash[j : j + count] * p
        text = self.text_of()
        at = np.flatnonzero(text[:count] == text[n - 1 :])
        return mix64(total[at]), at


def char_grams(texts: Sequence[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n characters inside one text, and the text they stand in."""
    cp = code_points("".join(texts))
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    text = np.repeat(np.arange(len(texts)), length)
    count = len(cp) - n + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(text[:count] == text[n - 1 :])
    return span_hash(prefix_hash(cp), at, at + n), text[at]


def sliding_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every run of width values, in logarithmically many passes."""
    count = len(values) - width + 1
    if count <= 0:
        return values[:0]
    low, have = values, 1
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[:count], low[width - have : width - have + count]) if have < width else low


def seeds(prefix: np.ndarray, start: int, end: int, gram: int, width: int) -> np.ndarray:
    """Hashes of the grams of a text [start, end) that are least in some run of width grams.

    Any passage of gram + width - 1 characters that two texts share holds a seed of both.
    """
    at = np.arange(start, end - gram + 1)
    if len(at) < width:
        return np.zeros(0, U64)
    return np.unique(sliding_minima(span_hash(prefix, at, at + gram), width))
