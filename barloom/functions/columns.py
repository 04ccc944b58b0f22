"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null where the divisor is zero."""
    return F.try_divide(top, bottom)


def clean(value: Column) -> Column:
    """Null, NaN and infinities become 0."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    return F.coalesce(finite, F.lit(0.0))


def clean_sql(value: str) -> str:
    """``clean`` for an expression given as SQL text."""
    return f"coalesce(nullif(nullif(nanvl(CAST({value} AS DOUBLE), 0D), double('Infinity')), double('-Infinity')), 0D)"


def log(value: Column) -> Column:
    """Natural logarithm, null outside its domain."""
    return F.when(value > 0, F.ln(value))


def log10(value: Column) -> Column:
    return F.when(value > 0, F.log10(value))


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the left-closed bucket of ``seconds`` that holds ``ts``."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / seconds) * seconds)


def gap_seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def total(array: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a * b))

