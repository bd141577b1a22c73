"""Reproducible pseudo-random draws, a function of the row's own keys.

A lost task that is run again draws the same numbers, and any engine with md5
can reproduce them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(parts, n: int) -> Column:
    text = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A draw from [0, 1) with 32 bits."""
    return _digits(parts, 8) / F.lit(4294967296.0)


def draw_key(*parts) -> Column:
    """A non-negative BIGINT with 60 bits, for orders and samples."""
    return _digits(parts, 15)
