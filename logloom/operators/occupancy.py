"""Work in progress and busy resource pools at the start of each event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.times import micros
from logloom.operators.positions import sliced_totals
from logloom.schema import NO_ROLE


def _open_events(changes: DataFrame, pool: list[str]) -> DataFrame:
    """(pool, us, open): events with start <= us < end, at each change.

    Summed slice by slice, so one busy pool, or the whole log, is many tasks.
    """
    net = changes.groupBy(*pool, "us").agg(F.sum("change").alias("change"))
    return sliced_totals(net, pool, ["us"], "change", "open").select(*pool, "us", "open")


def pool_occupancy(log: DataFrame, pools: DataFrame) -> DataFrame:
    """Adds ``open_events``, ``role_busy`` and ``role_share`` to each event.

    ``pools(role, users)`` gives the number of resources of a role; the share
    is NULL for an unknown role.
    """
    role = F.coalesce("role", F.lit(NO_ROLE))
    events = log.withColumns({"_role": role, "_us": micros("start_timestamp")})
    edges = F.array(
        F.struct(F.col("_us").alias("us"), F.lit(1).alias("change")),
        F.struct(micros("end_timestamp").alias("us"), F.lit(-1).alias("change")),
    )
    changes = events.select("_role", F.explode(edges).alias("e")).select("_role", "e.*")
    busy = _open_events(changes, ["_role"]).withColumnsRenamed({"us": "_us", "open": "role_busy"})
    overall = _open_events(changes, []).withColumnsRenamed({"us": "_us", "open": "open_events"})
    sized = pools.select(F.col("role").alias("_role"), "users")
    return (
        events.join(busy, ["_role", "_us"])
        .join(overall, "_us")
        .join(sized, "_role", "left")
        .withColumn("role_share", F.col("role_busy") / F.col("users"))
        .drop("_role", "_us", "users")
    )
