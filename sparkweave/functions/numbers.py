"""Numeric, conditional and cast functions of the dialect, where they differ from Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Half away from zero on doubles; an integer for no digits."""
    if digits <= 0:
        return F.round(x, digits).cast("long")
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale


def mod(a: Column, b: Column) -> Column:
    """The sign of the dividend; a divisor of 0 gives NULL."""
    return F.try_mod(a, b)


def sqrt(x: Column) -> Column:
    """NULL for negative numbers."""
    return F.when(x >= 0, F.sqrt(x))


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def truncate(x: Column, digits: int = 0) -> Column:
    """Toward zero."""
    scale = 10.0**digits
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def divide(a: Column, b: Column) -> Column:
    """NULL for a divisor of 0."""
    return F.try_divide(a, b)


def choose(test: Column, yes: Column, no: Column) -> Column:
    """IF / IIF: a number other than 0 is true, NULL is not."""
    return F.when(F.coalesce(test.cast("boolean"), F.lit(False)), yes).otherwise(no)


def cast(x: Column, kind: str) -> Column:
    """NULL where the value has no such form; texts other than true, 1 and yes are FALSE as booleans; numbers are cut toward zero as integers."""
    kind = kind.lower()
    if kind in ("int", "integer", "bigint"):
        return F.coalesce(x.try_cast("bigint"), x.try_cast("double").try_cast("bigint"))
    if kind in ("float", "double", "real"):
        return x.try_cast("double")
    if kind in ("bool", "boolean"):
        text = F.lower(x.cast("string"))
        return F.when(x.isNotNull(), text.isin("true", "1", "yes"))
    if kind in ("text", "varchar", "string"):
        return x.cast("string")
    return x.try_cast(kind) if kind in ("timestamp", "date") else x
