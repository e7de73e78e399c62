"""Rates and quotas. Undefined is null: never zero, infinity or NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from escrutinio.functions.checks import checked

LOW_COUNT_THRESHOLD = 20.0  # fixed value: expected events below which a rate is unstable


def ratio(num: Column, den: Column) -> Column:
    """EXP-01. Double division, null on a zero or null denominator."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def penetration(votes: str = "votos", electors: str = "aptos") -> Column:
    """EXP-02. Votes per thousand registered electors."""
    return F.lit(1000.0) * ratio(F.col(votes), F.col(electors))


def share_of_valid(votes: str = "votos", valid: str = "validos") -> Column:
    """EXP-03. Percentage of the valid votes."""
    return F.lit(100.0) * ratio(F.col(votes), F.col(valid))


def votes_per_km2(votes: str = "votos", area: str = "area_km2") -> Column:
    """EXP-04."""
    return ratio(F.col(votes), F.col(area))


def integer_div(a: Column, b: Column) -> Column:
    """Integer division that stays in 64-bit arithmetic."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def electoral_quotient(valid: Column, seats: Column) -> Column:
    """EXP-05. Valid votes per seat in integers; a fraction above one half rounds up."""
    v, s = valid.cast("bigint"), seats.cast("bigint")
    rounded = integer_div(v, s) + F.when(2 * (v % s) > s, F.lit(1)).otherwise(F.lit(0))
    return checked(
        rounded, (s > 0) & (v >= 0), "electoral quotient undefined for (valid, seats)", v, s
    )


def expected_events(electors: Column, rate: Column) -> Column:
    """Events expected in a unit at the reference rate."""
    return electors.cast("double") * rate


def is_low_count(expected: Column, threshold: float = LOW_COUNT_THRESHOLD) -> Column:
    """EXP-07. True when the expectation is undefined or below the threshold."""
    return expected.isNull() | (expected < threshold)


def per_candidacy(value: Column, n: Column) -> Column:
    """EXP-27. Value divided by the number of eligible candidacies."""
    return ratio(value, n)
