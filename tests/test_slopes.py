"""Slopes selected by counting inversions, against lists of all pairs."""

import time
import tracemalloc

import numpy as np
import pytest

from borefield.functions import stats
from borefield.functions.slopes import Slopes


def every_slope(x, t):
    i, j = np.triu_indices(len(x), 1)
    dt = t[j] - t[i]
    return np.sort(((x[j] - x[i])[dt != 0]) / dt[dt != 0])


def cases(n, rng):
    t = np.arange(n, dtype=float)
    yield "noise", rng.normal(size=n) + 0.01 * t, t
    yield "uneven", rng.normal(size=n), np.cumsum(rng.exponential(size=n))
    yield "tied values", rng.integers(0, 4, n).astype(float), t
    yield "tied times", rng.normal(size=n), np.sort(rng.integers(0, max(1, n // 3), n)).astype(float)
    yield "line", 3 - 0.1 * t, t
    yield "constant", np.full(n, 2.5), t
    yield "rounded", np.round(np.cumsum(rng.normal(size=n)), 1), t / 365.25


@pytest.mark.parametrize("n", [2, 3, 40, 500])
def test_any_rank(n):
    rng = np.random.default_rng(n)
    for name, x, t in cases(n, rng):
        expect = every_slope(x, t)
        found = Slopes(x, t, listed=max(1, len(expect) // 50))
        assert found.total == len(expect)
        ranks = sorted({0, len(expect) // 3, (len(expect) - 1) // 2, len(expect) // 2, len(expect) - 1})
        if len(expect):
            assert found.kth(ranks) == [expect[k] for k in ranks], name
            below, most = found.upto(float(np.median(expect)))
            assert below <= (expect < np.median(expect)).sum() and most >= (expect <= np.median(expect)).sum(), name


def test_a_hundred_thousand_points():
    n, rng = 100_000, np.random.default_rng(9)
    x, t = 0.37 * np.arange(n) + rng.normal(size=n) * 50, np.arange(n, dtype=float)
    start = time.process_time()
    tracemalloc.start()
    slope, lower, upper = stats.sens_slope(x, t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lower < slope < upper and abs(slope - 0.37) < 1e-4
    below, most = Slopes(x, t).upto(slope)
    assert below <= n * (n - 1) // 4 <= most
    assert peak < 1000 * n and time.process_time() - start < 240  # a list of pairs would take 40 GB
