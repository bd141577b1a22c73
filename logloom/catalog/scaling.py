"""Registered queries: scaling and its inverse."""

from pyspark.sql import functions as F

from logloom.catalog import sql as S
from logloom.catalog.common import INTERVAL, big, r6
from logloom.functions.scaling import (
    fit_scalers, rescaled, scale_feature, scale_features, scaled,
)
from logloom.operators.features import add_calculated_times
from logloom.sources.adapters import shipment_log, user_day_log

# method -> (feature, SQL expression of the scaled value over ft and st)
METHODS = {
    "lognorm": ("wait", "(ln(1 + wait) - lo) / (hi - lo)", "min(ln(1 + wait)) AS lo, max(ln(1 + wait)) AS hi"),
    "normal": ("dur", "(dur - lo) / (hi - lo)", "min(dur) AS lo, max(dur) AS hi"),
    "standard": ("acc_cycle", "(acc_cycle - mu) / sd", "avg(acc_cycle) AS mu, stddev_pop(acc_cycle) AS sd"),
    "max": ("dur", "dur / hi", "max(dur) AS hi"),
    "day_secs": ("daytime", "daytime / 86400.0", "max(1) AS one"),
    None: ("dur", "dur", "max(1) AS one"),
}


def _scale(method, feature):
    def query(spark, folder):
        log = add_calculated_times(user_day_log(spark, folder))
        log, _ = scale_feature(log, feature, method)
        return log.select(
            big("event_key", "event_id"), F.round(f"{feature}_norm", 7) + 0.0
        ).toDF("event_id", "scaled")

    return query


def _scale_sql(method):
    _, value, fit = METHODS[method]
    return S.with_(
        S.USER_DAY_LOG, S.TIMED, f"st AS (SELECT {fit} FROM ft)",
        select=f"SELECT o1 AS event_id, {S.rnd(value, 'scaled', 7)} FROM ft, st",
    )


ROUNDTRIP = ("lognorm", "normal", "standard", "max")


def rescale_roundtrip(spark, folder):
    """Scaled and rescaled with every method; ``max`` rounds to seconds."""
    log = add_calculated_times(shipment_log(spark, folder))
    log = log.withColumns({m: F.col("dur") for m in ROUNDTRIP})
    args = fit_scalers(log, {m: m for m in ROUNDTRIP})
    back = {m: rescaled(scaled(F.col(m), args[m], m), args[m], m) for m in ROUNDTRIP}
    return log.select(
        "caseid", F.col("event_key.*"), *[r6(c, f"dur_{m}") for m, c in back.items()]
    )


def scale_features_inter(spark, folder):
    log = add_calculated_times(user_day_log(spark, folder))
    log, _ = scale_features(log, "inter", INTERVAL, "lognorm", ["daytime", "weekday", "acc_cycle"])
    return log.select(
        big("event_key", "event_id"), big("weekday"),
        *[r6(f"{c}_norm") for c in ("dur", "wait", "acc_cycle")],
        # k / 86400 never lies half way between two 7-digit decimals
        F.round("daytime_norm", 7).alias("daytime_norm"),
    )


def scale_features_basic(spark, folder):
    log = add_calculated_times(user_day_log(spark, folder))
    log, _ = scale_features(log, "basic", INTERVAL, "max")
    return log.select(big("event_key", "event_id"), r6("dur_norm"), r6("wait_norm"))


_LOG_RANGE = ", ".join(
    f"min(ln(1 + {c})) AS {c}_lo, max(ln(1 + {c})) AS {c}_hi" for c in ("dur", "wait", "acc_cycle")
)


def _log_norm(c):
    return S.r6(f"(ln(1 + {c}) - {c}_lo) / ({c}_hi - {c}_lo)", f"{c}_norm")


QUERIES = {
    **{
        f"scale_{m or 'none'}": (_scale(m, METHODS[m][0]), _scale_sql(m))
        for m in METHODS
    },
    "rescale_roundtrip": (
        rescale_roundtrip,
        S.with_(S.SHIPMENT_LOG, S.TIMED, "st AS (SELECT max(dur) AS hi FROM ft)", select=f"""
            SELECT caseid, o1 AS l_linenumber, o2 AS l_partkey, o3 AS l_suppkey,
              {S.r6("dur", "dur_lognorm")}, {S.r6("dur", "dur_normal")},
              {S.r6("dur", "dur_standard")}, {S.r6("round_even(dur, 0)", "dur_max")}
            FROM ft, st"""),
    ),
    "scale_features_basic": (
        scale_features_basic,
        S.with_(S.USER_DAY_LOG, S.TIMED,
            "st AS (SELECT max(dur) AS dhi, max(wait) AS whi FROM ft)", select=f"""
            SELECT o1 AS event_id, {S.r6("dur / dhi", "dur_norm")},
              {S.r6("wait / whi", "wait_norm")} FROM ft, st"""),
    ),
    "scale_features_inter": (
        scale_features_inter,
        S.with_(S.USER_DAY_LOG, S.TIMED, f"st AS (SELECT {_LOG_RANGE} FROM ft)", select=f"""
            SELECT o1 AS event_id, weekday, {_log_norm("dur")}, {_log_norm("wait")},
              {S.rnd("daytime / 86400.0", "daytime_norm", 7)}, {_log_norm("acc_cycle")}
            FROM ft, st"""),
    ),
}
