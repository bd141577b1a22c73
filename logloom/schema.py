"""The event-log table: column names, order key and types."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Pseudo-activities in logs and decoded predictions, and column names (fixed values).
PSEUDO_EVENTS = ("Start", "End")
SENTINELS = ("Start", "End", "start", "end")
SYSTEM_USER = "AUTO"
START_LABEL, END_LABEL = "start", "end"
NO_ROLE = "NO_ROLE"

COLUMN_NAMES = {
    "Case ID": "caseid",
    "Activity": "task",
    "lifecycle:transition": "event_type",
    "Resource": "user",
}

# Timestamps carry no zone, so they are TIMESTAMP_NTZ and results do not
# depend on the session time zone.
EVENT_LOG = T.StructType(
    [
        T.StructField("caseid", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("start_timestamp", T.TimestampNTZType()),
        T.StructField("end_timestamp", T.TimestampNTZType()),
    ]
)


@dataclass(frozen=True)
class LogSchema:
    """How the events of a case are ordered.

    ``one_timestamp`` logs hold point events (``end_timestamp`` only), other
    logs hold intervals. ``tiebreak`` columns make the order total; rows equal
    in all of them must be interchangeable.
    """

    one_timestamp: bool = False
    tiebreak: tuple[str, ...] = ("event_key",)

    @property
    def key(self) -> str:
        return "end_timestamp" if self.one_timestamp else "start_timestamp"

    @property
    def order(self) -> list[str]:
        return [self.key, *self.tiebreak]

    @property
    def times(self) -> list[str]:
        return ["dur"] if self.one_timestamp else ["dur", "wait"]

    @property
    def times_norm(self) -> list[str]:
        return [f"{t}_norm" for t in self.times]


def drop_pseudo_events(log):
    return log.where(~F.col("task").isin(*PSEUDO_EVENTS))


def drop_sentinels(log):
    return log.where(~F.col("task").isin(*SENTINELS))


def drop_system_user(log):
    """Keeps rows without a user, as ``user != 'AUTO'`` does in pandas."""
    return log.where(~F.col("user").eqNullSafe(F.lit(SYSTEM_USER)))


def prefix_cases(log, prefix="Case"):
    return log.withColumn("caseid", F.concat(F.lit(prefix), F.col("caseid").cast("string")))
