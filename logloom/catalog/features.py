"""Registered queries: time features."""

from pyspark.sql import functions as F

from logloom.catalog import sql as S
from logloom.catalog.common import POINT, r6
from logloom.functions.times import micros
from logloom.operators.features import add_calculated_times
from logloom.sources.adapters import order_log, shipment_log, user_day_log, user_log

def calc_times_interval(spark, folder):
    log = add_calculated_times(shipment_log(spark, folder))
    return log.select(
        "caseid", "task", "user",
        micros("start_timestamp").alias("start_us"), micros("end_timestamp").alias("end_us"),
        r6("dur"), r6("wait"), r6("acc_cycle"),
    )


def calc_times_point(spark, folder):
    log = add_calculated_times(order_log(spark, folder), POINT)
    return log.select(
        "caseid", "task", F.col("event_key").alias("o_orderkey"),
        micros("end_timestamp").alias("end_us"), r6("dur"), r6("acc_cycle"),
    )


def daytime_weekday(spark, folder):
    log = add_calculated_times(user_day_log(spark, folder))
    return log.groupBy("weekday", F.expr("daytime div 3600").alias("hour")).agg(
        F.count(F.lit(1)).alias("events"), F.sum("daytime").alias("daytime_sum")
    ).select(F.col("weekday").cast("bigint").alias("weekday"), "hour", "events", "daytime_sum")


def activity_times(spark, folder):
    """Mean times per activity over the encoded, timed log."""
    log = add_calculated_times(user_log(spark, folder))
    means = {c: F.avg(c) for c in ("dur", "wait", "acc_cycle")}
    out = log.groupBy("task").agg(
        F.count(F.lit(1)).alias("events"), *[m.alias(c) for c, m in means.items()]
    )
    return out.select("task", "events", *[F.round(c, 3).alias(c) for c in means])


QUERIES = {
    "calc_times_interval": (
        calc_times_interval,
        S.with_(S.SHIPMENT_LOG, S.TIMED, select=f"""
            SELECT caseid, task, usr AS "user", s_us AS start_us, e_us AS end_us,
              {S.r6("dur")}, {S.r6("wait")}, {S.r6("acc_cycle")} FROM ft"""),
    ),
    "calc_times_point": (
        calc_times_point,
        S.with_(S.ORDER_LOG, S.TIMED_POINT, select=f"""
            SELECT caseid, task, o1 AS o_orderkey, e_us AS end_us,
              {S.r6("dur")}, {S.r6("acc_cycle")} FROM ft"""),
    ),
    "daytime_weekday": (
        daytime_weekday,
        S.with_(S.USER_DAY_LOG, S.TIMED, select="""
            SELECT weekday, daytime // 3600 AS hour, count(*) AS events,
              CAST(sum(daytime) AS BIGINT) AS daytime_sum FROM ft GROUP BY 1, 2"""),
    ),
    "activity_times": (
        activity_times,
        S.with_(S.USER_LOG, S.TIMED, select="""
            SELECT task, count(*) AS events, round(avg(dur), 3) AS dur,
              round(avg(wait), 3) AS wait, round(avg(acc_cycle), 3) AS acc_cycle
            FROM ft GROUP BY task"""),
    ),
}
