"""Whether a record is long and dense enough to test, and why not."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import half_even


@dataclass(frozen=True)
class Thresholds:
    """Limits a record must meet; observations are readings as they came, not months."""

    min_span_years: float = 8.0
    min_observations: int = 20
    min_distinct_years: int = 5
    max_gap_fraction: float = 0.40
    min_years_for_climatology: int = 3
    min_months_for_climatology: int = 8
    min_months: int = 3  # the test's own need; only reached under permissive limits


def insufficient_reason(t: Thresholds) -> Column:
    """All failed limits joined by "; " in a fixed order; null where none failed."""
    total = F.greatest(F.col("n_months_total"), F.lit(1))
    tenths = half_even(F.greatest(total - 1, F.lit(0)) * 10, F.lit(12))
    span = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    missing = F.when(F.col("n_months_total") > 0, half_even((total - F.col("n_months_present")) * 100, total)).otherwise(100)
    n, years, months = F.col("n_observations"), F.col("distinct_years"), F.col("n_months_present")
    say = F.concat
    reasons = F.array_compact(
        F.array(
            F.when(n < t.min_observations, say(F.lit("only "), n.cast("string"), F.lit(f" observations (need {t.min_observations})"))),
            F.when(F.col("span_years") < t.min_span_years, say(F.lit("record spans "), span, F.lit(f" years (need {t.min_span_years:.0f})"))),
            F.when(years < t.min_distinct_years, say(F.lit("only "), years.cast("string"), F.lit(f" distinct years (need {t.min_distinct_years})"))),
            F.when(
                F.col("gap_fraction") > t.max_gap_fraction,
                say(missing.cast("string"), F.lit(f"% of months missing (limit {t.max_gap_fraction:.0%})")),
            ),
            F.when(months < t.min_months, say(F.lit("only "), months.cast("string"), F.lit(f" months with data (need {t.min_months})"))),
        )
    )
    # The test's own need is only told where nothing else failed.
    first = F.filter(reasons, lambda r: ~r.contains("months with data"))
    told = F.when(F.size(first) > 0, first).otherwise(reasons)
    return F.when(F.size(told) > 0, F.array_join(told, "; "))


def assess(coverage: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """`coverage` with sufficient, insufficient_reason and can_deseasonalise. The gate comes before any test."""
    t = thresholds or Thresholds()
    enough = (F.col("distinct_years") >= t.min_years_for_climatology) & (F.col("months_covered") >= t.min_months_for_climatology)
    out = coverage.withColumn("insufficient_reason", insufficient_reason(t))
    return out.withColumns({"sufficient": F.col("insufficient_reason").isNull(), "can_deseasonalise": enough})
