import numpy as np
import pytest
from pyspark.sql import functions as F

from borefield.functions import stats
from borefield.operators import monthly

rng = np.random.default_rng(99)


def ar1(n, phi, sd, rng):
    x = np.zeros(n)
    for i, e in enumerate(rng.normal(0, sd, n)):
        x[i] = (phi * x[i - 1] if i else 0) + e
    return x


@pytest.mark.parametrize("x, s", [(range(10), 45), (range(10, 0, -1), -45), ([3.0] * 8, 0)])
def test_s_of_monotone_and_tied(x, s):
    assert stats.kendall_s(np.array(x, float)) == s


def test_s_in_blocks_is_that_of_all_pairs():
    x = rng.integers(0, 50, 1500).astype(float)
    assert stats.kendall_s(x) == np.triu(np.sign(x[None, :] - x[:, None]), 1).sum()


def test_ties_lower_the_variance():
    assert stats.tie_correction(np.array([1.0, 1, 2, 3, 3, 3])) == 2 * 1 * 9 + 3 * 2 * 11
    assert stats.classic_variance(np.array([1.0, 1, 2])) < stats.classic_variance(np.array([1.0, 2, 3]))


def test_average_ranks():
    assert stats.average_ranks(np.array([5.0, 1, 5, 2])).tolist() == [3.5, 1, 3.5, 2]


def test_slopes():
    t = np.arange(100.0)
    assert stats.sens_slope(5 + 0.37 * t, t)[0] == pytest.approx(0.37)
    x = 10 + 0.2 * np.arange(60.0)
    x[[5, 17, 40]] += 50
    slope, low, high = stats.sens_slope(x, np.arange(60.0))
    assert slope == pytest.approx(0.2, abs=0.02) and low <= slope <= high
    t = np.array([0, 0.5, 3, 3.25, 9, 14.5])
    assert stats.sens_slope(100 - 0.4 * t, t)[0] == pytest.approx(-0.4)
    assert np.isnan(stats.sens_slope(np.array([1.0, 2]), np.zeros(2))[0])


def test_too_short_has_no_test():
    assert stats.mann_kendall(np.array([1.0, 2.0])) is None
    with pytest.raises(ValueError):
        stats.check_variance("other")


def test_autocorrelation_inflates_the_variance():
    x = ar1(200, 0.85, 1.0, np.random.default_rng(3))
    assert stats.mann_kendall(x)[6] > 1


def test_false_positives():
    own = np.random.default_rng(99)
    paths = [ar1(120, 0.85, 1.0, own) for _ in range(120)]
    rate = {v: np.mean([stats.mann_kendall(x, variance=v)[4] < 0.05 for x in paths]) for v in stats.VARIANCES}
    assert rate["classic"] > 0.30 and rate["hamed_rao"] < 0.75 * rate["classic"]


def test_two_passes_remove_the_season_and_keep_the_slope():
    months = np.arange(2008 * 12, 2008 * 12 + 120)
    x = 330 - 0.05 * np.arange(120) + 4.5 * np.sin(2 * np.pi * (months % 12) / 12)
    flat = stats.deseasonalise(months, x)
    slope = stats.sens_slope(flat, np.arange(120.0))[0]
    assert slope == pytest.approx(-0.05, abs=1e-6)
    assert np.std(flat - slope * np.arange(120)) < 0.01


def test_average_rank_of_ties_and_nulls(spark):
    rows = [(1, 5.0), (1, 5.0), (1, 2.0), (1, None), (2, None), (2, None), (None, 1.0)]
    got = monthly.average_rank(spark.createDataFrame(rows, "k int, v double"), "k", "v").collect()
    assert len(got) == len(rows)
    assert {(r.k, r.v): r["rank"] for r in got} == {(1, 5.0): 3.5, (1, 2.0): 2.0, (1, None): 1.0, (2, None): 1.5, (None, 1.0): 1.0}


@pytest.mark.parametrize("n", [3, 4, 5, 26, 84])
@pytest.mark.parametrize("ties", [False, True])
def test_series_of_one_length_at_once(n, ties):
    """Bit by bit what each series gives alone."""
    rng = np.random.default_rng(n)
    months = np.array([np.sort(rng.choice(n + 40, n, replace=False)) + 23_000 for _ in range(30)])
    x = rng.integers(0, 3, (30, n)).astype(float) if ties else np.round(rng.normal(size=(30, n)).cumsum(1), 5)
    season = rng.random(30) < 0.6
    how = (0.05, "hamed_rao", 6, 9)
    alone = [stats._trend(m, v, o, *how) for m, v, o in zip(months, x, season, strict=True)]
    assert np.array_equal(stats._trends(months, x, season, *how), np.array(alone, float))
