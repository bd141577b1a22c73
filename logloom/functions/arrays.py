"""Array expressions shared by the sample builders and predictors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_last(values: Column, n: int, zero: Column) -> Column:
    """The last ``n`` elements, filled up with ``zero`` on the left."""
    return F.slice(F.concat(F.array_repeat(zero, n), values), -n, n)


def push(values: Column, value: Column, n: int) -> Column:
    """Slides a window of ``n`` elements by one."""
    return F.concat(F.slice(values, 2, n - 1), F.array(value))


def one_hot(index: Column, size: int) -> Column:
    """0/1 array of length ``size``; all zeros for an index outside of it."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("int"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def joined(values: Column, digits: int | None = None) -> Column:
    """Comma-separated text of an array, doubles rounded to ``digits``."""
    if digits is not None:
        values = F.transform(values, lambda v: F.format_string(f"%.{digits}f", v))
    return F.array_join(values.cast("array<string>"), ",")
