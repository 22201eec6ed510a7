"""Monthly medians with gaps kept as gaps, and what a series covers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import null_safe, running_sum
from .selection import exact_medians, sorted_medians


def month_index(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at) - 1).cast("int")


def month_start(month: Column) -> Column:
    return F.make_date(F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))


def monthly_median(readings: DataFrame, key: str = "bore_id", value: str = "value", at: str = "observed_at", bounded: bool = False) -> DataFrame:
    """(key, month_idx, value, n): the exact median of each month that has values, and how many.

    Null and nan values are left out; a value without a time makes a row of null month_idx, which still counts as
    an observation but stands in no month. Keyed by series and month, so one long series is spread over its months. A task sorts
    a month's values unless `bounded`, which narrows the middles of crowded months down over stable `readings`, in more passes.
    """
    clean = readings.select(key, month_index(F.col(at)).alias("month_idx"), F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("value")).where("value IS NOT NULL")
    found = (exact_medians if bounded else sorted_medians)(clean, [key, "month_idx"])
    return found.select(key, "month_idx", F.col("median").alias("value"), "n")


def series_coverage(monthly: DataFrame, key: str = "bore_id") -> DataFrame:
    """Per series: readings, months present and in all, longest gap, distinct years, calendar months covered."""
    order = Window.partitionBy(key).orderBy("month_idx")
    present = F.col("month_idx").isNotNull()
    gaps = monthly.withColumn("gap", F.col("month_idx") - F.lag("month_idx").over(order) - 1)
    return gaps.groupBy(key).agg(*coverage_columns(present, F.max("gap")))


def coverage_columns(present: Column, longest: Column) -> list[Column]:
    total = F.coalesce(F.max("month_idx") - F.min("month_idx") + 1, F.lit(0))
    n_present = F.count(F.when(present, 1))
    return [
        F.sum("n").alias("n_observations"),
        n_present.alias("n_months_present"),
        total.cast("long").alias("n_months_total"),
        F.when(total > 0, 1 - n_present / F.when(total > 0, total)).otherwise(1.0).alias("gap_fraction"),
        F.when(total > 1, (total - 1) / F.lit(12.0)).otherwise(0.0).alias("span_years"),
        F.coalesce(longest, F.lit(0)).cast("long").alias("longest_gap_months"),
        F.size(F.collect_set(F.floor(F.col("month_idx") / 12))).cast("long").alias("distinct_years"),
        F.size(F.collect_set(F.col("month_idx") % 12)).cast("long").alias("months_covered"),
    ]


def monthly_grid(monthly: DataFrame, key: str = "bore_id") -> DataFrame:
    """Every month from a series' first to its last; those without values have null value and n = 0."""
    known = monthly.where("month_idx IS NOT NULL")
    ends = known.groupBy(key).agg(F.min("month_idx").alias("first"), F.max("month_idx").alias("last"))
    spine = ends.select(key, F.explode(F.sequence("first", "last")).alias("month_idx"))
    return spine.join(known, [key, "month_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def climatology(monthly: DataFrame, key: str = "bore_id") -> DataFrame:
    """(key, month 1 to 12, value): medians by month of the year, null where there are none; twelve rows a series."""
    known = monthly.where("month_idx IS NOT NULL")
    found = known.groupBy(key, (F.col("month_idx") % 12 + 1).alias("month")).agg(F.median("value").alias("value"))
    spine = known.select(key).distinct().select(key, F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return spine.join(found, [key, "month"], "left")


def with_positions(monthly: DataFrame, key: str = "bore_id") -> DataFrame:
    """The three time axes of a series: squeezed position, months since the first, elapsed years of 365.25 days."""
    whole = Window.partitionBy(key)
    first = F.min("month_idx").over(whole)
    return monthly.where("month_idx IS NOT NULL").withColumns(
        {
            "position": F.row_number().over(whole.orderBy("month_idx")) - 1,
            "month_offset": F.col("month_idx") - first,
            "elapsed_years": F.datediff(month_start(F.col("month_idx")), month_start(first)) / F.lit(365.25),
        }
    )


def average_rank(df: DataFrame, key: str, value: str) -> DataFrame:
    """`df` with rank: ties share the mean of their ranks; nulls are one tie and come first.

    Equal values are counted, and the counts are summed along the values by a prefix scan, so a key of any size is ranked by several tasks.
    """
    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    before = running_sum(counts, [key], [value], "_less", F.col("_n"))
    ranks = before.select(key, value, (F.col("_less") + (F.col("_n") + 1) / F.lit(2.0)).alias("rank"))
    return null_safe(df, ranks, [key, value])


def as_series(monthly: DataFrame, key: str = "bore_id") -> DataFrame:
    """(key, months array, values array), in time order: at most twelve entries a year."""
    pairs = F.array_sort(F.collect_list(F.when(F.col("month_idx").isNotNull(), F.struct("month_idx", "value"))))
    return monthly.groupBy(key).agg(pairs.alias("s")).select(key, F.col("s.month_idx").alias("months"), F.col("s.value").alias("values"))
