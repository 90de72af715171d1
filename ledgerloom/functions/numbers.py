"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

Col = Column | str


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Col) -> Column:
    """The value, or NULL when it is NaN or infinite."""
    x = col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def rounded(c: Col, digits: int = 2) -> Column:
    return F.round(finite(c), digits)


def rounded_scaled(c: Col, digits: int) -> Column:
    """Half away from zero after scaling as a double, the way SQL engines round doubles: 58.949999999999996 * 10 is 589.5, so 59.0. ``F.round`` rounds its decimal form, to 58.9."""
    return F.round(col(c) * 10.0**digits, 0) / 10.0**digits


def pct_from(value: Col, reference: Col) -> Column:
    """Distance of ``value`` from ``reference`` in percent; NULL for a missing or zero reference."""
    return (F.try_divide(col(value), col(reference)) - 1) * 100.0


def clamp(c: Col, low: int, high: int) -> Column:
    return F.least(F.greatest(col(c), F.lit(low)), F.lit(high))


def sign(c: Col) -> Column:
    """-1, 0 or 1 as an integer."""
    return F.signum(col(c)).cast("int")


def ranked_probabilities(c: Col) -> Column:
    """A probability map as (label, probability) entries, most likely first, ties by label."""
    entries = F.map_entries(col(c))
    return F.array_sort(
        entries,
        lambda a, b: F.when(a["value"] > b["value"], -1)
        .when(a["value"] < b["value"], 1)
        .when(a["key"] < b["key"], -1)
        .when(a["key"] > b["key"], 1)
        .otherwise(0),
    )
