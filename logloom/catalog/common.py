"""Prepared logs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.arrays import joined
from logloom.operators.encode import encode_log
from logloom.operators.features import add_calculated_times
from logloom.schema import LogSchema
from logloom.sources.adapters import user_day_log

INTERVAL, POINT = LogSchema(), LogSchema(one_timestamp=True)


def r6(column, name: str | None = None) -> Column:
    """Rounded to 6 digits; adding zero turns -0.0 into 0.0."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, 6) + F.lit(0.0)).alias(name or column)


def text(column, digits=None, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return joined(c, digits).alias(name or column)


def big(column, name: str | None = None) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("bigint").alias(name or column)


def user_roles(log: DataFrame) -> DataFrame:
    """A fixed rule that stands in for discovered roles: ten groups of users."""
    return log.withColumn("role", F.concat(F.lit("R"), F.expr("cast(user as int) % 10")))




def prepared(spark, folder):
    """Timed, encoded log of short cases: (log, activities, roles, ends)."""
    log, activities, roles = encode_log(user_roles(user_day_log(spark, folder)))
    log = add_calculated_times(log)
    return log, activities, roles, {"ac_index": activities.end, "rl_index": roles.end}
