"""Exact order statistics and k-smallest selections without a global sort."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.positions import global_rank
from logloom.runtime import pin

# Histogram cells per pass; bounds what the driver reads.
CELLS = 16_384


@dataclass(frozen=True)
class Cut:
    """The k-th smallest value, the rows below it and the rows equal to it."""

    value: int
    below: int
    tied: int
    k: int


def share(q: float) -> Callable[[int], int]:
    """rows -> the smallest integer that is at least ``q * rows``."""
    exact = Fraction(repr(q))
    return lambda rows: math.ceil(exact * rows)


def kth_smallest(df: DataFrame, column: str, pick: Callable[[int], int]) -> Cut | None:
    """k-th smallest BIGINT of ``column``, k = ``pick(rows)``, counting from 1.

    Narrows an interval by histograms of fixed size: a handful of map-side
    combined counts, whatever the number of rows and however they are tied.
    """
    x = F.col(column)
    low, high, rows = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if not rows:
        return None
    k = min(max(pick(rows), 1), rows)
    below, tied = 0, rows
    while low < high:
        # Few rows left: one cell per value settles it.
        width = 1 if tied <= CELLS else -(-(high - low + 1) // CELLS)
        cells = df.where(x.between(low, high)).groupBy(
            F.expr(f"(`{column}` - {low}L) div {width}L").alias("cell")
        )
        for cell, n in sorted(cells.count().collect()):  # at most CELLS rows
            if below + n >= k:
                low, high = low + cell * width, min(high, low + (cell + 1) * width - 1)
                tied = n
                break
            below += n
    return Cut(low, below, tied, k)


def quantile_disc(df: DataFrame, column: str, q: float) -> int | None:
    """Smallest value with a cumulative share of at least ``q``."""
    cut = kth_smallest(df, column, share(q))
    return cut.value if cut else None


def flag_smallest(df: DataFrame, column: str, tiebreak: list[str], pick, out: str) -> DataFrame:
    """Marks the first k rows in the order (column, tiebreak).

    Only rows tied at the k-th value are ranked by the tiebreak, and only if
    the cut runs through them. Reads ``df`` several times, so pin it first if
    it is more than a scan.
    """
    cut = kth_smallest(df, column, pick)
    x = F.col(column)
    if cut is None or cut.below + cut.tied == cut.k:
        return df.withColumn(out, x <= (cut.value if cut else 0))
    tied = global_rank(pin(df.where(x == cut.value)), tiebreak, "_rank", cut.tied)
    tied = tied.withColumn(out, F.col("_rank") <= cut.k - cut.below).drop("_rank")
    return df.where(x != cut.value).withColumn(out, x < cut.value).unionByName(tied)


def sample_rows(df: DataFrame, key: str, tiebreak: list[str], pick) -> DataFrame:
    """k rows without replacement: those with the smallest draw ``key``.

    Reads ``df`` several times, as ``flag_smallest`` does.
    """
    return flag_smallest(df, key, tiebreak, pick, "_taken").where("_taken").drop("_taken")
