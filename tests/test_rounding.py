"""Rounding that must agree with SQL's in every digit."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from borefield.functions import naming, numbers, stats


def test_sizes_of_any_whole_number(spark):
    rng = random.Random(4)
    sizes = [72617631198216199, 0, 1023, 1024, 1024**2 - 1, 1024**3 - 1, 2**63 - 1, 2**62 + 1, 2**53 + 1, 5 * 2**28, 15 * 2**28 + 1] + [rng.randrange(2 ** rng.randrange(1, 63)) for _ in range(3000)]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", naming.human_bytes(F.col("n")).alias("s")).collect()
    for n, s in got:
        power, unit = next((p, u) for p, u in ((0, "B"), (1, "KB"), (2, "MB"), (3, "GB")) if n < 1024 ** (p + 1) or u == "GB")
        assert s == (f"{n}B" if not power else f"{n / 1024**power:.1f}{unit}"), n


def test_half_even_beyond_doubles(spark):
    rows = [(10**18 - 1, 10**9), (2**62 + 1, 2), (2**62 + 3, 2), (25, 10), (35, 10)]
    got = spark.createDataFrame(rows, "a long, b long").select(numbers.half_even(F.col("a"), F.col("b")).alias("q")).collect()
    assert [r.q for r in got] == [10**9, 2**61, 2**61 + 2, 2, 4]


def test_doubles_round_as_sql_rounds_them(spark):
    import duckdb

    rng = np.random.default_rng(6)
    x = np.concatenate([(2 * rng.integers(-(10**9), 10**9, 3000) + 1) / 2e6, rng.normal(size=1000) * 1e3, [0.0, 0.4999999, -5e-7, 1e300, -1e18, np.inf]])
    frame = pd.DataFrame({"i": np.arange(len(x)), "x": x})
    theirs = duckdb.sql("SELECT round(x, 6) AS r FROM frame ORDER BY i").fetchnumpy()["r"]
    ours = spark.createDataFrame(frame).orderBy("i").select(numbers.half_away(F.col("x"), 6).alias("r")).toPandas()["r"].to_numpy()
    assert (ours == theirs).all()
    finite = np.abs(x) < 1e12
    assert (stats._rounded(x[finite], 6) == theirs[finite]).all()


def test_detrended_values_that_lie_halfway(spark):
    """The values tested are rounded as they come, too, and halves go away from zero before ranking."""
    months = np.arange(80)
    x = np.round(np.random.default_rng(3).normal(size=80).cumsum(), 5)
    noisy = x + 3e-11
    for values in (x, noisy):
        row = spark.createDataFrame([(months.tolist(), values.tolist())], "m array<int>, v array<double>").select(stats.trend_udf(0.05, "hamed_rao", 6)("m", "v", F.lit(True)).alias("t")).first().t
        seasonless = sql_round(stats.deseasonalise(months, x), 9)
        detrended = sql_round(seasonless - stats.sens_slope(seasonless, months.astype(float))[0] * months, 6)
        assert row.factor == stats.hamed_rao_factor(detrended, 0.0)
    halves = np.array([0.5, 1.5, 2.5, 2.0, 3.0, 1.0, -0.5, 0.25, 4.0])
    assert stats.hamed_rao_factor(halves, 0.0, decimals=0) == stats.hamed_rao_factor(np.array([1.0, 2, 3, 2, 3, 1, -1, 0, 4]), 0.0)


def sql_round(x, decimals):
    import duckdb

    frame = pd.DataFrame({"i": np.arange(len(x)), "x": x})
    return duckdb.sql(f"SELECT round(x, {decimals}) AS r FROM frame ORDER BY i").fetchnumpy()["r"]
