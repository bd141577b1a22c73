import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from logloom.functions import scaling as S
from logloom.functions.times import add_seconds, micros
from logloom.operators import features as X
from logloom.schema import LogSchema, drop_pseudo_events, drop_system_user, prefix_cases

POINT = LogSchema(one_timestamp=True)


def test_interval_times(tiny_log):
    got = rows_of(X.add_calculated_times(tiny_log), "event_key", "dur", "wait", "acc_cycle")
    assert got == [
        (0, 10.0, 0.0, 10.0),
        (1, 15.0, 5.0, 30.0),
        (2, 30.0, 0.0, 50.0),  # the negative wait is clamped
        (3, 0.0, 0.0, 0.0),
        (4, 5.0, 60.0, 65.0),
    ]


def test_point_times(tiny_log):
    log = tiny_log.drop("start_timestamp")
    got = rows_of(X.add_calculated_times(log, POINT), "event_key", "dur", "acc_cycle", "daytime")
    assert got == [
        (0, 0.0, 0.0, 28810), (1, 20.0, 20.0, 28830), (2, 20.0, 40.0, 28850),
        (3, 0.0, 0.0, 28805), (4, 65.0, 65.0, 28870),
    ]


def test_weekday_starts_on_monday(tiny_log):
    got = X.add_calculated_times(tiny_log).select("weekday", "daytime").first()
    assert tuple(got) == (0, 28800)


def test_equal_timestamps_follow_the_tiebreak(make_log):
    log = make_log([("c", "A", "u", 0, 7), ("c", "B", "u", 0, 9)])
    got = rows_of(X.add_calculated_times(log, POINT), "event_key", "dur")
    assert got == [(0, 0.0), (1, 2.0)]
    got = rows_of(X.add_calculated_times(log), "event_key", "wait", "acc_cycle")
    assert got == [(0, 0.0, 7.0), (1, 0.0, 9.0)]


def test_filters(tiny_log, make_log):
    log = make_log([("c", "Start", "u", 0, 0), ("c", "A", None, 0, 0), ("c", "B", "AUTO", 1, 1)])
    assert rows_of(drop_pseudo_events(log), "task") == [("A",), ("B",)]
    assert rows_of(drop_system_user(log), "task") == [("A",), ("Start",)]
    assert prefix_cases(log).first()["caseid"] == "Casec"


def test_sample_columns():
    extra = ["daytime", "weekday", "acc_cycle"]
    assert X.sample_columns(LogSchema(), extra) == [
        "ac_index", "rl_index", "dur_norm", "daytime_norm", "weekday", "acc_cycle_norm", "wait_norm",
    ]
    assert X.sample_columns(POINT) == ["ac_index", "rl_index", "dur_norm"]


def test_filter_features(tiny_log):
    log = X.add_calculated_times(tiny_log)
    log = log.withColumns({"role": F.lit("r"), "ac_index": F.lit(1), "rl_index": F.lit(1)})
    assert X.filter_features(log, LogSchema(), ["weekday"]).columns == [
        "caseid", "task", "user", "end_timestamp", "role", "dur", "ac_index", "rl_index",
        "start_timestamp", "wait", "weekday", "event_key",
    ]


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([(0.0, 5.0), (1.0, 5.0), (3.0, 5.0)], "x double, flat double")


@pytest.mark.parametrize(
    "method, expected",
    [
        ("lognorm", [0.0, 0.5, 1.0]),
        ("normal", [0.0, 1 / 3, 1.0]),
        ("standard", [-1.069045, -0.267261, 1.336306]),
        ("max", [0.0, 1 / 3, 1.0]),
        ("day_secs", [0.0, 1 / 86400, 3 / 86400]),
        (None, [0.0, 1.0, 3.0]),
    ],
)
def test_scaling(values, method, expected):
    scaled, args = S.scale_feature(values, "x", method, replace=True)
    assert "x" not in scaled.columns
    got = [r[0] for r in rows_of(scaled, "x_norm")]
    assert got == pytest.approx(expected, abs=1e-6)
    if method not in ("day_secs",):
        back = scaled.select(S.rescaled(F.col("x_norm"), args, method).alias("x"))
        assert [r[0] for r in rows_of(back)] == pytest.approx([0.0, 1.0, 3.0])


@pytest.mark.parametrize("method", ["lognorm", "normal", "standard"])
def test_degenerate_scale_is_zero(values, method):
    scaled, _ = S.scale_feature(values, "flat", method)
    assert {r[0] for r in rows_of(scaled, "flat_norm")} == {0.0}


def test_max_of_nonpositive_values_is_zero(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,)], "x double")
    assert {r[0] for r in rows_of(S.scale_feature(df, "x", "max")[0], "x_norm")} == {0.0}


def test_max_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    got = df.select(S.rescaled(F.col("x"), {"max_value": 1.0}, "max").alias("y"))
    assert rows_of(got) == [(0.0,), (2.0,), (2.0,)]


def test_unknown_methods_are_refused(values):
    with pytest.raises(ValueError):
        S.fit_scaler(values, "x", "other")
    with pytest.raises(ValueError):
        S.rescaled(F.col("x"), {}, "day_secs")
    with pytest.raises(ValueError):
        S.profile_methods("other", LogSchema(), "max")


def test_inter_profile_replaces_extra_columns(tiny_log):
    log = X.add_calculated_times(tiny_log)
    log, args = S.scale_features(log, "inter", LogSchema(), "max", ["daytime", "weekday", "acc_cycle"])
    assert {"dur", "wait", "weekday", "daytime_norm", "acc_cycle_norm"} <= set(log.columns)
    assert not {"daytime", "acc_cycle"} & set(log.columns)
    assert args["wait"] == {"max_value": 60.0} and args["daytime"] == {"max_value": 86400.0}


def test_add_seconds_keeps_micros(tiny_log):
    got = tiny_log.select((micros(add_seconds("end_timestamp", F.lit(1.0000015))) - micros("end_timestamp")).alias("d"))
    assert {r["d"] for r in got.collect()} <= {1000001, 1000002}
