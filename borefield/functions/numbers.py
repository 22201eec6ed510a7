"""Exact arithmetic of whole numbers, and rounding as SQL engines do it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(top: Column, bottom: Column) -> Column:
    """top / bottom of whole numbers to the nearest whole number, ties to even: exact, unlike rounding a double."""
    whole, rest = F.call_function("div", top, bottom), top % bottom
    up = (rest * 2 > bottom) | ((rest * 2 == bottom) & (whole % 2 == 1))
    return (whole + up.cast("long")).cast("long")


def half_away(c: Column, decimals: int) -> Column:
    """A double to so many decimals: scaled, to the nearest whole number, ties away from zero, and scaled back.

    F.round to decimals works on the printed digits instead, so both differ where the scaled value is a tie and the printed one isn't, or the
    reverse. `c` stands here once: what it is made of isn't computed again.
    """
    return F.round(c * 10.0**decimals, 0) / F.lit(10.0**decimals)
