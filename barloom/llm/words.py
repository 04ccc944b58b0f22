"""Texts of an Arrow batch as numpy: bytes, words and hashes of any stretch of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

# Symbols hashed at once; stretches of this many bytes bound the memory for powers and prefix sums.
CHUNK = 1 << 20
# Odd multipliers of the rolling hashes (any odd numbers would do).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Everything but ASCII letters, digits and non-ASCII bytes.
PUNCTUATION = np.ones(256, bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
# Lower case for ASCII letters only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit numbers (xor-shift and multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# A random 64-bit number per byte value.
BYTE = scramble(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[0]))


def _powers(base: int, n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in cache or len(cache[base][0]) < n:
        def run(b: int) -> np.ndarray:
            x = np.full(n, b, np.uint64)
            x[0] = 1
            return np.multiply.accumulate(x)

        cache[base] = run(base), run(pow(base, -1, 1 << 64))
    return cache[base]


class Rolling:
    """Hashes of stretches [start, end) of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, base: int = BASES[0]):
        up, self.down = _powers(base, max(len(symbols) + 1, CHUNK + 4096))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:len(symbols)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return scramble((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def flatten(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offsets of each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a batch: byte positions, hashes, and for each text its range of words."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE, fold: bool = False,
          prefix: int | None = None) -> Words:
    """Words between bytes marked in ``breaks``; hashes of the first ``prefix`` bytes if given."""
    inside = ~breaks[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = np.unique(offsets[:-1][np.diff(offsets) > 0])
    opens[edges] = inside[edges]
    ends = edges[1:] - 1
    closes[ends] = inside[ends]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    stop = end if prefix is None else np.minimum(end, start + prefix)
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # stretches that begin and end with a word
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK)))
        lo, hi = start[at], end[to - 1]
        piece = raw[lo:hi]
        hashes[at:to] = Rolling(BYTE[LOWER[piece] if fold else piece])(start[at:to] - lo, stop[at:to] - lo)
        at = to
    return Words(start, end, hashes, np.searchsorted(start, offsets))
