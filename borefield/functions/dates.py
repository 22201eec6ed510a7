"""Which field of a slash date is the day, and parsing once that is known."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a date with slashes or dashes looks.
_DATE = r"^\s*(\d{1,4})[/-](\d{1,2})[/-](\d{1,4})"
#: Directives and Spark's letters for them; whatever else a format holds stands for itself.
_JAVA = {
    "%d": "d", "%m": "M", "%Y": "yyyy", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "D", "%H": "H", "%I": "h", "%p": "a", "%M": "m", "%S": "s",
    "%f": "SSSSSS", "%%": "%",
}


class AmbiguousDatesError(ValueError):
    """A column's dates can be read day first or month first."""


def date_order(value: Column, weight: Column | None = None) -> Column:
    """An aggregate: year_first, day_first, month_first, ambiguous, or null where too few values look like dates.

    Over all values, not a sample: at least three, and four fifths of those that aren't null, must match. A row stands for
    `weight` values (one if not given).
    """
    weight = F.lit(1) if weight is None else weight
    text = value.cast("string")
    looks = text.rlike(_DATE)
    first, second = (F.max(F.when(looks, F.regexp_extract(text, _DATE, i).cast("int"))) for i in (1, 2))
    n, matching = (F.coalesce(F.sum(F.when(c, weight)), F.lit(0)) for c in (text.isNotNull(), looks))
    return (
        F.when((matching < 3) | (matching * 5 < n * 4), F.lit(None).cast("string"))
        .when(first > 31, "year_first")
        .when(first > 12, "day_first")
        .when(second > 12, "month_first")
        .otherwise("ambiguous")
    )


def may_hold_text(field: T.StructField) -> bool:
    """Columns that could hold dates as text: all but numbers, dates, times and booleans."""
    return not isinstance(field.dataType, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType | T.BooleanType)


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if may_hold_text(f)]


def require_unambiguous_dates(df: DataFrame, declared: dict[str, str]) -> None:
    """Raise naming every text column without a declared format whose date order can't be told. One pass."""
    columns = [c for c in text_columns(df) if c not in declared]
    if columns:
        verdicts = df.agg(*(date_order(F.col(f"`{c}`")).alias(c) for c in columns)).first().asDict()
        if bad := [c for c in columns if verdicts[c] == "ambiguous"]:
            raise AmbiguousDatesError(f"day and month can't be told apart in {', '.join(bad)}; declare their formats")


class DateFormatError(ValueError):
    """A declared format that can't be read."""


def java_pattern(strptime: str) -> str:
    """A strptime format as Spark's; letters that are no directive are quoted, a directive that isn't known raises."""
    parts, out = re.findall(r"%.?|[^%]+", strptime), []
    for i, part in enumerate(parts):
        if part[0] == "%":
            if part not in _JAVA:
                raise DateFormatError(f"{part} in {strptime} isn't known; known are {' '.join(_JAVA)}")
            # Numbers without anything between them have two digits each.
            touching = any(x[0] == "%" for x in parts[max(i - 1, 0) : i] + parts[i + 1 : i + 2])
            out.append(_JAVA[part] * 2 if touching and part in ("%d", "%m", "%H", "%I", "%M", "%S") else _JAVA[part])
        else:
            out.append("'" + part.replace("'", "''") + "'" if re.search(r"[A-Za-z'\[\]#{}]", part) else part)
    return "".join(out)


def parse_dates(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Declared columns as timestamps; columns not there are passed over; a value that doesn't fit raises."""
    return df.withColumns({c: F.to_timestamp(F.col(f"`{c}`"), java_pattern(f)) for c, f in formats.items() if c in df.columns})
