"""Trace-ordered time features of an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.times import daytime, seconds_between, weekday
from logloom.operators.positions import Frame, over_traces
from logloom.schema import LogSchema


def _interval_times(frame: Frame) -> dict:
    gap = seconds_between(F.lag("end_timestamp").over(frame.rows), "start_timestamp")
    return {
        "dur": seconds_between("start_timestamp", "end_timestamp"),
        "acc_cycle": seconds_between(frame.case_start, "end_timestamp"),
        "wait": F.greatest(F.coalesce(gap, F.lit(0.0)), F.lit(0.0)),
    }


def _point_times(frame: Frame) -> dict:
    gap = seconds_between(F.lag("end_timestamp").over(frame.rows), "end_timestamp")
    return {
        "dur": F.coalesce(gap, F.lit(0.0)),
        "acc_cycle": seconds_between(frame.case_start, "end_timestamp"),
    }


def add_calculated_times(log: DataFrame, schema: LogSchema = LogSchema(), hot=None) -> DataFrame:
    """Adds ``dur``, ``acc_cycle``, (``wait``,) ``daytime`` and ``weekday``.

    One exchange on the case and one sort serve all of them.
    """
    times = _point_times if schema.one_timestamp else _interval_times
    timed = over_traces(log, schema, times, back=1, hot=hot)
    return timed.withColumns({"daytime": daytime(schema.key), "weekday": weekday(schema.key)})


def filter_features(log: DataFrame, schema: LogSchema, add_cols=()) -> DataFrame:
    """The columns the models use, plus the tiebreak that orders them."""
    columns = ["caseid", "task", "user", "end_timestamp", "role", "dur", "ac_index", "rl_index"]
    if not schema.one_timestamp:
        columns += ["start_timestamp", "wait"]
    columns += [c for c in (*add_cols, *schema.tiebreak) if c not in columns]
    return log.select(*columns)


def sample_columns(schema: LogSchema, add_cols=()) -> list[str]:
    """Columns of a sample: indexes, times and the scaled extra attributes."""
    extra = [c if c == "weekday" else f"{c}_norm" for c in add_cols]
    tail = [] if schema.one_timestamp else ["wait_norm"]
    return ["ac_index", "rl_index", "dur_norm", *extra, *tail]
