"""Rolling hashes and seeds of texts laid end to end as one array of code points.

All hashes are 64 bit and depend on nothing but the text; what they find is verified.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

U64 = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_CHAR = U64(0xBF58476D1CE4E5B9)
_POWERS: dict[int, np.ndarray] = {}

#: A slice of a batch holds about so many characters; bounds the memory of the numpy passes.
SLICE_CHARS = 300_000


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


def placed_seeds(texts: Sequence[str], gram: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of several texts: hash, text number, and place in the text.

    A gram is a seed if it is least in some run of width grams; a passage of
    gram + width - 1 characters that two texts share has the same seeds in both.
    """
    cp = code_points("".join(texts))
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), length)
    count = len(cp) - gram + 1
    if count < width:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(count)
    value = span_hash(prefix_hash(cp), at, at + gram)
    kept = owner[:count] == owner[gram - 1 :]
    if width > 1:
        # The greatest minimum of the runs around a gram is the gram itself if one run has it
        # as its minimum.  Runs over a text's end would bring seeds that another text lacks.
        low = sliding_minima(value, width)
        low = np.where(owner[: len(low)] == owner[gram + width - 2 :], low, U64(0))
        around = np.concatenate([np.zeros(width - 1, U64), low, np.zeros(width - 1, U64)])
        kept &= ~sliding_minima(~around, width) == value
    at = np.flatnonzero(kept)
    first = np.cumsum(length) - length
    return value[at], owner[at], at - first[owner[at]]
