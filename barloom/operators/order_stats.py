"""Ranks, quantiles and places of extremes in long windows, at n log n per block (RW7-RW9)."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """A wavelet matrix over numbers below 2**bits: counts and order statistics of any stretch in ``bits`` steps."""

    def __init__(self, numbers: np.ndarray):
        self.bits = max(1, int(numbers.max(initial=0)).bit_length())
        self.levels = []
        rest = numbers
        for b in reversed(range(self.bits)):
            one = (rest >> b & 1).astype(bool)
            zeros = np.concatenate([[0], np.cumsum(~one)])
            self.levels.append((zeros, int(zeros[-1])))
            rest = np.concatenate([rest[~one], rest[one]])

    def less(self, lo: np.ndarray, hi: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many numbers at places [lo, hi) are below ``than``."""
        found = np.zeros(len(lo), np.int64)
        for b, (zeros, n) in zip(reversed(range(self.bits)), self.levels, strict=True):
            a, z = zeros[lo], zeros[hi]
            one = (than >> b & 1).astype(bool)
            found += np.where(one, z - a, 0)
            lo, hi = np.where(one, n + lo - a, a), np.where(one, n + hi - z, z)
        return found

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The number with ``k`` smaller ones (equal ones in order) at places [lo, hi)."""
        found = np.zeros(len(lo), np.int64)
        for zeros, n in self.levels:
            a, z = zeros[lo], zeros[hi]
            one = k >= z - a
            k = np.where(one, k - (z - a), k)
            lo, hi = np.where(one, n + lo - a, a), np.where(one, n + hi - z, z)
            found = found << 1 | one
        return found


def _first_extreme(values: np.ndarray, lo: np.ndarray, w: int) -> np.ndarray:
    """Place of the first largest value in [lo, lo + w): two overlapping stretches of a power of two."""
    place, size = np.arange(len(values)), 1
    while 2 * size <= w:
        left, right = place[:len(place) - size], place[size:]
        place = np.where(values[left] >= values[right], left, right)
        size *= 2
    left, right = place[lo], place[lo + w - size]
    return np.where(values[left] >= values[right], left, right)


def window_stats(close: np.ndarray, high: np.ndarray, low: np.ndarray, windows: tuple[int, ...],
                 shares: tuple[float, float] = (0.8, 0.2)) -> dict[str, np.ndarray]:
    """For each window and row: ``less`` and ``equal`` closes, quantiles ``qu`` and ``qd``, first places ``fh`` and ``fl``
    of the highest high and lowest low. NaN where the window is not full of values. Time grows with rows times log rows,
    whatever the windows."""
    n, out = len(close), {}
    sorted_, ranks = np.unique(np.where(np.isnan(close), 0.0, close), return_inverse=True)
    tree = Wavelet(ranks.ravel()) if n else None

    def full(x: np.ndarray, w: int) -> np.ndarray:
        seen = np.concatenate([[0], np.cumsum(~np.isnan(x))])
        return seen[w:] - seen[:-w] == w if n >= w else np.zeros(0, bool)

    for w in windows:
        made = {k: np.full(n, np.nan) for k in ("less", "equal", "qu", "qd", "fh", "fl")}
        lo = np.flatnonzero(full(close, w))
        if len(lo):
            hi, own = lo + w, ranks.ravel()[lo + w - 1]
            below = tree.less(lo, hi, own)
            made["less"][hi - 1] = below
            top = own + 1
            upto = np.where(top >= 1 << tree.bits, w, tree.less(lo, hi, np.minimum(top, (1 << tree.bits) - 1)))
            made["equal"][hi - 1] = upto - below
            for name, share in zip(("qu", "qd"), shares, strict=True):
                at = share * (w - 1)
                k = int(np.floor(at))
                a = sorted_[tree.kth(lo, hi, np.full(len(lo), k))]
                b = sorted_[tree.kth(lo, hi, np.full(len(lo), min(k + 1, w - 1)))]
                made[name][hi - 1] = a * (k + 1 - at) + b * (at - k) if at > k else a
        for name, x, sign in (("fh", high, 1.0), ("fl", low, -1.0)):
            lo = np.flatnonzero(full(x, w))
            if len(lo):
                made[name][lo + w - 1] = _first_extreme(np.where(np.isnan(x), -np.inf, sign * x), lo, w) - lo
        out |= {f"{k}_{w}": v for k, v in made.items()}
    return out
