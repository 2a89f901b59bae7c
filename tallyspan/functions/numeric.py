"""Number expressions shared by metrics and forecasting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def r6(value: Column) -> Column:
    """Six decimals, and never a negative zero."""
    return F.round(value, 6) + F.lit(0.0)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def is_close(a: Column, b: Column, rtol: float, atol: float) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def floor_zero(value: Column) -> Column:
    """At least zero; unlike a bare `greatest`, an unknown value stays unknown."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


def clip(value: Column, bound: float) -> Column:
    return F.when(value.isNotNull(), F.greatest(F.lit(-bound), F.least(F.lit(bound), value)))


def combine(base: Column, correction: Column, bound: float, weight: float) -> Column:
    """Floored base plus a bounded, weighted correction, floored again."""
    return floor_zero(floor_zero(base) + weight * clip(correction, bound))


def combine_unbounded(base: Column, correction: Column) -> Column:
    return floor_zero(base + correction)


def percent_of(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole * 100)
