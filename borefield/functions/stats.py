"""The numeric kernel: rank statistics of one series, and Arrow-batched functions over arrays of series."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .slopes import Slopes

VARIANCES = ("classic", "hamed_rao")
TEST = "n int, s double, var_s double, z double, p_value double, tau double, factor double, effective_n double"
SLOPE = "slope double, lower double, upper double"
#: Pairs compared at once, so that memory doesn't grow with the square of a series' length.
_ROWS = 512


def quantile(alpha: float) -> float:
    return NormalDist().inv_cdf(1 - alpha / 2)


def kendall_s(x: np.ndarray) -> float:
    """Sum of the signs of later less earlier values, in blocks of rows."""
    total = 0.0
    for at in range(0, len(x), _ROWS):
        block = x[at : at + _ROWS]
        total += np.sign(x[None, at + len(block) :] - block[:, None]).sum()
        total += np.triu(np.sign(block[None, :] - block[:, None]), 1).sum()
    return float(total)


def tie_counts(x: np.ndarray) -> np.ndarray:
    counts = np.unique(x, return_counts=True)[1].astype(float)
    return counts[counts > 1]


def tie_correction(x: np.ndarray) -> float:
    t = tie_counts(x)
    return float((t * (t - 1) * (2 * t + 5)).sum())


def classic_variance(x: np.ndarray) -> float:
    n = float(len(x))
    return (n * (n - 1) * (2 * n + 5) - tie_correction(x)) / 18


def average_ranks(x: np.ndarray) -> np.ndarray:
    _, place, counts = np.unique(x, return_inverse=True, return_counts=True)
    last = np.cumsum(counts)
    return (last - (counts - 1) / 2.0)[place]


def sens_slope(x: np.ndarray, t: np.ndarray, alpha: float = 0.05) -> tuple[float, float, float]:
    """Median of the pairs' slopes and its distribution-free interval; nan where no two times differ. Pairs of long series aren't listed.

    The interval's ranks use the classic variance, whichever the test uses.
    """
    slopes = Slopes(x, t)
    n = slopes.total
    if not n:
        return math.nan, math.nan, math.nan
    c = quantile(alpha) * math.sqrt(max(classic_variance(x), 0.0))
    low, high = (min(max(r, 0), n - 1) for r in (math.floor((n - c) / 2), math.ceil((n + c) / 2)))
    before, after, lower, upper = slopes.kth([(n - 1) // 2, n // 2, low, high])
    return (before if n % 2 else (before + after) / 2), lower, upper


def _rounded(x: np.ndarray, decimals: int | None) -> np.ndarray:
    """Ties go away from zero, as in SQL and in `numbers.half_away`."""
    if decimals is None:
        return x
    scaled = x * 10.0**decimals
    near = np.rint(scaled)
    return np.where(np.abs(scaled - near) == 0.5, scaled + np.copysign(0.5, scaled), near) / 10.0**decimals


def hamed_rao_factor(x: np.ndarray, slope: float, alpha: float = 0.05, decimals: int | None = None) -> float:
    """n / n* from the autocorrelation of the detrended ranks.

    Lags are summed up to the first that lies inside Anderson's lag-dependent bounds; later lags are never computed.
    `decimals` rounds the detrended values before ranking, so that values equal but for rounding noise tie.
    """
    n = len(x)
    if n < 4:
        return 1.0
    r = average_ranks(_rounded(x - slope * np.arange(n), decimals))
    r = r - (n + 1) / 2
    power = float(r @ r)
    if not power:
        return 1.0
    z, total = quantile(alpha), 0.0
    for lag in range(1, n - 2):
        m = n - lag
        rho, width = float(r[:m] @ r[lag:]) / power, z * math.sqrt(m - 1)
        if -1 - width < rho * m < -1 + width:
            break
        total += m * (m - 1.0) * (m - 2.0) * rho
    return max(1 + 2 / (n * (n - 1.0) * (n - 2.0)) * total, 1e-6)


def mann_kendall(x: np.ndarray, alpha: float = 0.05, variance: str = "hamed_rao", decimals: int | None = None) -> tuple | None:
    """(n, S, Var, z, p, tau, factor, effective n); None under three values."""
    n = len(x)
    if n < 3:
        return None
    s, var, factor = kendall_s(x), classic_variance(x), 1.0
    if variance == "hamed_rao":
        factor = hamed_rao_factor(x, sens_slope(x, np.arange(n, dtype=float), alpha)[0], alpha, decimals)
        var *= factor
    z = (s - np.sign(s)) / math.sqrt(var) if var > 0 else 0.0
    p = 2 * (1 - 0.5 * (1 + math.erf(abs(z) / math.sqrt(2))))
    pairs, t = n * (n - 1) / 2, tie_counts(x)
    bottom = math.sqrt((pairs - float((t * (t - 1) / 2).sum())) * pairs)
    return n, s, var, float(z), p, s / bottom if bottom > 0 else 0.0, factor, n / factor


def climatology(months: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Medians by month of the year, 0 to 11; nan for months without values."""
    return np.array([np.median(own) if len(own := x[months % 12 == m]) else math.nan for m in range(12)])


def deseasonalise(months: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values less the climatology of their detrended copy; positions count missing months too."""
    slope = sens_slope(x, (months - months[0]).astype(float))[0] if len(x) >= 3 else math.nan
    flat = x - slope * (months - months[0]) if math.isfinite(slope) else x
    return x - np.nan_to_num(climatology(months, flat)[months % 12])


def elapsed_years(months: np.ndarray) -> np.ndarray:
    """Whole days since the first month's start, in years of 365.25 days."""
    starts = (months - 1970 * 12).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return (starts - starts[..., :1]) / 365.25


#: Series of up to so many values are computed together with others of their length; pairs and places that such a block may have.
SHORT, _PLACES = 256, 1 << 20


@lru_cache(16)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _steps(x: np.ndarray) -> np.ndarray:
    """Later less earlier values of all pairs of each row."""
    i, j = _pairs(x.shape[1])
    return np.take(x, j, axis=1) - np.take(x, i, axis=1)


def _below_and_equal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value of each row, how many of the row are smaller, and how many the same."""
    return (x[:, None, :] < x[:, :, None]).sum(2), (x[:, None, :] == x[:, :, None]).sum(2)


def _variances(equal: np.ndarray) -> np.ndarray:
    n = float(equal.shape[1])
    return (n * (n - 1) * (2 * n + 5) - ((equal - 1.0) * (2 * equal + 5)).sum(1)) / 18


def sens_slopes(x: np.ndarray, t: np.ndarray, alpha: float = 0.05) -> np.ndarray:
    """`sens_slope` of rows of one length whose times ascend: a row (slope, lower, upper) each."""
    slopes = np.sort(_steps(x) / _steps(t), axis=1)
    n = slopes.shape[1]
    c = quantile(alpha) * np.sqrt(np.maximum(_variances(_below_and_equal(x)[1]), 0.0))
    ends = [np.clip(r, 0, n - 1).astype(np.int64) for r in (np.floor((n - c) / 2), np.ceil((n + c) / 2))]
    middle = slopes[:, n // 2] if n % 2 else (slopes[:, n // 2 - 1] + slopes[:, n // 2]) / 2
    return np.column_stack([middle, *(slopes[np.arange(len(x)), at] for at in ends)])


def hamed_rao_factors(x: np.ndarray, slope: np.ndarray, alpha: float = 0.05, decimals: int | None = None) -> np.ndarray:
    """`hamed_rao_factor` of rows of one length; a row leaves at its first lag inside the bounds."""
    n = x.shape[1]
    total = np.zeros(len(x))
    if n < 4:
        return total + 1
    below, equal = _below_and_equal(_rounded(x - slope[:, None] * np.arange(n), decimals))
    r = below + (equal + 1) / 2 - (n + 1) / 2
    power, z = (r * r).sum(1), quantile(alpha)
    left = np.flatnonzero(power)
    for lag in range(1, n - 2):
        m = n - lag
        rho, width = (r[left, :m] * r[left, lag:]).sum(1) / power[left], z * math.sqrt(m - 1)
        out = ~((-1 - width < rho * m) & (rho * m < -1 + width))
        left, rho = left[out], rho[out]
        if not len(left):
            break
        total[left] += m * (m - 1.0) * (m - 2.0) * rho
    return np.maximum(1 + 2 / (n * (n - 1.0) * (n - 2.0)) * total, 1e-6)


def mann_kendalls(x: np.ndarray, alpha: float = 0.05, variance: str = "hamed_rao", decimals: int | None = None) -> np.ndarray:
    """`mann_kendall` of rows of one length, three at least."""
    n = x.shape[1]
    s, equal = np.sign(_steps(x)).sum(1), _below_and_equal(x)[1]
    var, factor = _variances(equal), np.ones(len(x))
    if variance == "hamed_rao":
        factor = hamed_rao_factors(x, sens_slopes(x, np.tile(np.arange(n, dtype=float), (len(x), 1)), alpha)[:, 0], alpha, decimals)
        var = var * factor
    z = np.divide(s - np.sign(s), np.sqrt(np.maximum(var, 0.0)), out=np.zeros(len(x)), where=var > 0)
    p = [2 * (1 - 0.5 * (1 + math.erf(abs(v) / math.sqrt(2)))) for v in z.tolist()]
    pairs = n * (n - 1) / 2
    bottom = np.sqrt((pairs - (equal - 1.0).sum(1) / 2) * pairs)
    tau = np.divide(s, bottom, out=np.zeros(len(x)), where=bottom > 0)
    return np.column_stack([np.full(len(x), float(n)), s, var, z, p, tau, factor, n / factor])


def deseasonalised(months: np.ndarray, x: np.ndarray) -> np.ndarray:
    """`deseasonalise` of rows of one length, three at least, whose months ascend."""
    since = (months - months[:, :1]).astype(float)
    flat, moy, out = x - sens_slopes(x, since)[:, :1] * since, months % 12, x.copy()
    for m in range(12):
        own = moy == m
        n = own.sum(1)
        ordered = np.sort(np.where(own, flat, np.inf), axis=1)
        row = np.arange(len(x))
        offset = np.where(n > 0, (ordered[row, np.maximum(n - 1, 0) // 2] + ordered[row, np.minimum(n // 2, x.shape[1] - 1)]) / 2, 0.0)
        out = np.where(own, x - offset[:, None], out)
    return out


def kendall_sums(series: list[np.ndarray]) -> np.ndarray:
    """`kendall_s` of each."""
    return _by_length(1, [(x, None) for x in series], lambda x, _: np.sign(_steps(x)).sum(1)[:, None], lambda x, _: kendall_s(x), 0)[:, 0]


def _trend(months: np.ndarray, x: np.ndarray, out_season: bool, alpha: float, variance: str, decimals: int | None, fine: int | None) -> tuple:
    x = _rounded(x, fine)
    x = _rounded(deseasonalise(months, x), fine) if out_season else x
    return *mann_kendall(x, alpha, variance, decimals), *sens_slope(x, elapsed_years(months), alpha)


def _trends(months: np.ndarray, x: np.ndarray, out_season: np.ndarray, alpha: float, variance: str, decimals: int | None, fine: int | None) -> np.ndarray:
    """`_trend` of rows of one length."""
    x = _rounded(x, fine)
    if out_season.any():
        x[out_season] = _rounded(deseasonalised(months[out_season], x[out_season]), fine)
    return np.hstack([mann_kendalls(x, alpha, variance, decimals), sens_slopes(x, elapsed_years(months), alpha)])


def _by_length(columns: int, series: list[tuple], together: Callable, alone: Callable, least: int) -> np.ndarray:
    """A row of figures for each of `series` (values, times or None, more): those of one length at once, long ones and such as aren't finite or in order alone.

    Rows of series under `least` values are nan.
    """
    out, same = np.full((len(series), columns), math.nan), defaultdict(list)
    for at, (x, t, *more) in enumerate(series):
        if x is None or len(x) < least:
            continue
        if len(x) <= SHORT and np.isfinite(x).all() and (t is None or (np.diff(t) > 0).all()):
            same[len(x)].append(at)
        else:
            out[at] = alone(x, t, *more)
    for n, places in same.items():
        step = max(_PLACES // n**2, 1)
        for first in range(0, len(places), step):
            part = places[first : first + step]
            x, t, *more = zip(*(series[at] for at in part), strict=True)
            out[part] = together(np.array(x), None if t[0] is None else np.array(t), *map(np.array, more))
    return out


def check_variance(variance: str) -> None:
    if variance not in VARIANCES:
        raise ValueError(f"unknown variance method {variance!r}")


def _frame(rows: np.ndarray, schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _array(v: object, kind: type) -> np.ndarray | None:
    return None if v is None else np.asarray(v, kind)


def test_udf(alpha: float = 0.05, variance: str = "hamed_rao", decimals: int | None = None):
    check_variance(variance)

    @F.pandas_udf(TEST)
    def run(values: pd.Series) -> pd.DataFrame:
        how = (alpha, variance, decimals)
        rows = _by_length(8, [(_array(v, float), None) for v in values], lambda x, _: mann_kendalls(x, *how), lambda x, _: mann_kendall(x, *how), 3)
        return _frame(rows, TEST).astype({"n": "Int32"})

    return run


def slope_udf(alpha: float = 0.05):
    @F.pandas_udf(SLOPE)
    def run(values: pd.Series, times: pd.Series) -> pd.DataFrame:
        series = [(_array(v, float), _array(t, float)) for v, t in zip(values, times, strict=True)]
        return _frame(_by_length(3, series, lambda x, t: sens_slopes(x, t, alpha), lambda x, t: sens_slope(x, t, alpha), 2), SLOPE)

    return run


def factor_udf(alpha: float = 0.05):
    """The variance factor of detrended values in order of time."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        series = [(np.asarray(v, float), None) for v in values]
        flat = lambda x: np.zeros(len(x))
        return pd.Series(_by_length(1, series, lambda x, _: hamed_rao_factors(x, flat(x), alpha)[:, None], lambda x, _: hamed_rao_factor(x, 0.0, alpha), 0)[:, 0])

    return run


def trend_udf(alpha: float, variance: str, decimals: int | None):
    """One pass over a series: seasonal part out if asked, the test, and the slope a year.

    `decimals` rounds detrended values before ranking, and, by three more, values as they come and once their season is out; None rounds nothing.
    """
    check_variance(variance)
    schema, fine = f"{TEST}, {SLOPE}", None if decimals is None else decimals + 3

    @F.pandas_udf(schema)
    def run(months: pd.Series, values: pd.Series, seasonal: pd.Series) -> pd.DataFrame:
        how = (alpha, variance, decimals, fine)
        series = [(_array(v, float) if m is not None else None, _array(m, np.int64), bool(out_season)) for m, v, out_season in zip(months, values, seasonal, strict=True)]
        rows = _by_length(11, series, lambda x, m, o: _trends(m, x, o, *how), lambda x, m, o: _trend(m, x, o, *how), 3)
        return _frame(rows, schema).astype({"n": "Int32"})

    return run
