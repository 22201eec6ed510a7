"""Order statistics of the slopes of all pairs of a series, in memory that is linear in its length.

A pair's slope is at most m where its later value less m times its time isn't above the earlier one's, so pairs up to a trial slope are
inversions, counted by merging without listing them. Trial slopes come from random pairs; when few pairs are left between two of
them, those alone are listed: they are the inversions between the orders at the two trials.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Pairs that may be listed; random pairs looked at for a trial.
LISTED, SAMPLED = 1 << 20, 1 << 15
_EPS = np.finfo(float).eps


def _merges(place: np.ndarray, bound: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of doubling width: (earlier members in order of place, later members, where the earlier ones at or above a later one's bound begin, where they end)."""
    n, width = len(place), 1
    at = np.arange(n)
    while width < n:
        row, later = at // (2 * width), at // width % 2 == 1
        left, right = at[~later], at[later]
        keys = row[left] * (n + 1) + place[left]
        order = np.argsort(keys, kind="stable")
        keys, left = keys[order], left[order]
        first = np.searchsorted(keys, row[right] * (n + 1) + bound[right])
        yield left, right, first, np.searchsorted(keys, (row[right] + 1) * (n + 1))
        width *= 2


def _inversions(y: np.ndarray, slack: float) -> int:
    """Pairs whose later value is below the earlier one by more than `slack`; at most above it by -slack, where that is negative."""
    ordered = np.sort(y)
    place = np.empty(len(y), np.int64)
    place[np.argsort(y, kind="stable")] = np.arange(len(y))
    bound = np.searchsorted(ordered, y + slack, "right" if slack >= 0 else "left")
    return sum(int((past - first).sum()) for _, _, first, past in _merges(place, bound))


class Slopes:
    """The slopes of a series' pairs of different times: how many there are, and the k-th."""

    def __init__(self, x: np.ndarray, t: np.ndarray, listed: int = LISTED, seed: int = 0):
        order = np.argsort(t, kind="stable")
        self.x, self.t, self.listed, self.rng = x[order].astype(float), t[order].astype(float), listed, np.random.default_rng(seed)
        starts = np.flatnonzero(np.diff(self.t, prepend=-np.inf) != 0)
        sizes = np.diff(np.append(starts, len(x)))
        self.same = [np.arange(a, a + n) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True) if n > 1]  # equal times are no pairs
        self.total = len(x) * (len(x) - 1) // 2 - int((sizes * (sizes - 1) // 2).sum())

    def kth(self, ranks: list[int]) -> list[float]:
        """The slopes of these ranks, from 0."""
        if self.total <= self.listed:
            every = np.sort(np.concatenate([s for _, s in self._rows(-np.inf, np.inf)])) if self.total else np.zeros(0)
            return [float(every[k]) for k in ranks]
        return [self._kth(k) for k in ranks]

    def upto(self, m: float) -> tuple[int, int]:
        """(pairs that are surely below m, pairs that may be at most m); they differ where slopes equal m but for rounding."""
        y = self.x - m * self.t
        slack = 8 * _EPS * float(np.abs(self.x).max() + abs(m) * np.abs(self.t).max())
        below, most = (_inversions(y, s) - sum(_inversions(y[g], s) for g in self.same) for s in (slack, -slack))
        return below, most

    def _rows(self, low: float, high: float) -> Iterator[tuple[int, np.ndarray]]:
        """(i, slopes of i with later members that lie from low to high)."""
        for i in range(len(self.x) - 1):
            dt = self.t[i + 1 :] - self.t[i]
            ok = dt > 0
            s = (self.x[i + 1 :][ok] - self.x[i]) / dt[ok]
            yield i, s if low == -np.inf and high == np.inf else s[(s >= low) & (s <= high)]

    def _sample(self, low: float, high: float) -> np.ndarray:
        """Slopes of random pairs from low to high."""
        found, tries = [], 0
        while sum(map(len, found)) < SAMPLED // 8 and tries < 64:
            i, j = self.rng.integers(0, len(self.x), (2, SAMPLED))
            i, j = np.minimum(i, j), np.maximum(i, j)
            ok = self.t[i] < self.t[j]
            s = (self.x[j[ok]] - self.x[i[ok]]) / (self.t[j[ok]] - self.t[i[ok]])
            found.append(s[(s > low) & (s < high)])
            tries += 1
        return np.sort(np.concatenate(found))

    def _kth(self, k: int) -> float:
        """Narrows (low, high), of which the counts are certain, round the k-th slope until few pairs are inside."""
        low, high, below, upto = -np.inf, np.inf, 0, self.total
        while upto - below > self.listed:
            sample = self._sample(low, high)
            share, spread = (k - below) / (upto - below), 2 / max(len(sample), 1) ** 0.5
            moved = False
            for aim in (share - spread, share + spread, share):
                at = int(aim * len(sample))
                if 0 < at < len(sample) and sample[at - 1] < sample[at]:
                    m = (sample[at - 1] + sample[at]) / 2
                    if low < m < high:
                        sure, most = self.upto(m)
                        if sure == most:
                            moved = True
                            if sure <= k and m > low:
                                low, below = m, sure
                            elif sure > k and m < high:
                                high, upto = m, sure
            if not moved:
                return self._counted(low, high, k - below)
        if np.isinf(low) or np.isinf(high):
            return self._counted(low, high, k - below)
        inside = self._between(low, high)
        return float(np.partition(inside, k - below)[k - below])

    def _between(self, low: float, high: float) -> np.ndarray:
        """The slopes between two certain trials: pairs that stand one way at `low` and the other way at `high`."""
        order = np.argsort(self.x - low * self.t, kind="stable")
        y = (self.x - high * self.t)[order]
        place = np.empty(len(y), np.int64)
        place[np.argsort(y, kind="stable")] = np.arange(len(y))
        found = []
        for left, right, first, past in _merges(place, np.searchsorted(np.sort(y), y, "right")):
            n = past - first
            i = order[left[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]]
            j = order[np.repeat(right, n)]
            found.append((self.x[j] - self.x[i]) / (self.t[j] - self.t[i]))
        return np.concatenate(found)

    def _counted(self, low: float, high: float, k: int) -> float:
        """The k-th from low to high where many are the same: values are counted a row at a time."""
        values, counts = np.zeros(0), np.zeros(0, np.int64)
        for _, s in self._rows(low, high):
            own, n = np.unique(s, return_counts=True)
            values, back = np.unique(np.concatenate([values, own]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, n]), len(values)).astype(np.int64)
        return float(values[np.searchsorted(np.cumsum(counts), k, "right")])
