"""Registered queries: logs written to the shared folder and read back."""

import uuid

from pyspark.sql import functions as F

from logloom.catalog import sql as S
from logloom.functions.times import micros
from logloom.runtime import shared_folder
from logloom.sources import logs
from logloom.sources.adapters import user_day_log


def _new_path(spark) -> str:
    return f"{shared_folder(spark)}/roundtrip/{uuid.uuid4().hex}"


def _shown(log):
    return log.select(
        "caseid", "task", "user",
        micros("start_timestamp").alias("start_us"), micros("end_timestamp").alias("end_us"),
    )


def csv_roundtrip(spark, folder):
    path = _new_path(spark)
    logs.write_log(user_day_log(spark, folder), path)
    return _shown(logs.read_test_log(spark, path))


def _transitions(log):
    """A ``start`` and a ``complete`` row for each event."""
    both = F.array(
        F.struct(F.lit("start").alias("event_type"), F.col("start_timestamp").alias("timestamp")),
        F.struct(F.lit("complete").alias("event_type"), F.col("end_timestamp").alias("timestamp")),
    )
    rows = log.select("caseid", "task", "user", F.explode(both).alias("e"))
    return rows.select("caseid", "task", "user", "e.*")


def lifecycle_pairs(spark, folder):
    return _shown(logs.pair_lifecycle(_transitions(user_day_log(spark, folder))))


def xes_roundtrip(spark, folder):
    """Times are written with an offset of two hours, so UTC must come back."""

    def attribute(tag, key, value):
        return F.concat(F.lit(f'<{tag} key="{key}" value="'), value, F.lit('"/>'))

    local = F.date_format(F.col("timestamp") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    event = F.concat(
        F.lit("<event>"),
        attribute("string", "concept:name", F.col("task")),
        attribute("string", "org:resource", F.col("user")),
        attribute("string", "lifecycle:transition", F.col("event_type")),
        attribute("date", "time:timestamp", F.concat(local, F.lit("+02:00"))),
        F.lit("</event>"),
    )
    rows = _transitions(user_day_log(spark, folder))
    events = rows.groupBy("caseid").agg(F.array_join(F.collect_list(event), "").alias("e"))
    case = attribute("string", "concept:name", F.col("caseid"))
    trace = F.concat(F.lit("<trace>"), case, F.col("e"), F.lit("</trace>"))
    path = _new_path(spark)
    events.select(trace.alias("value")).write.text(path)
    return _shown(logs.pair_lifecycle(logs.read_xes(spark, path)))


_PAIRED = """
    SELECT s.caseid, s.task, s.usr AS "user", s.s_us AS start_us, e.e_us AS end_us
    FROM (SELECT *, row_number() OVER (PARTITION BY caseid, task, usr ORDER BY s_us) AS k FROM lg) s
    JOIN (SELECT *, row_number() OVER (PARTITION BY caseid, task, usr ORDER BY e_us) AS k FROM lg) e
      USING (caseid, task, usr, k)"""

QUERIES = {
    "csv_roundtrip": (
        csv_roundtrip,
        S.with_(S.USER_DAY_LOG, select="""
            SELECT caseid, task, usr AS "user", s_us AS start_us, e_us AS end_us FROM lg"""),
    ),
    "xes_roundtrip": (xes_roundtrip, S.with_(S.USER_DAY_LOG, select=_PAIRED)),
    "lifecycle_pairs": (lifecycle_pairs, S.with_(S.USER_DAY_LOG, select=_PAIRED)),
}
