import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from helpers import plain_edit_distance, rows_of
from pyspark.sql import functions as F

from logloom.functions import distance
from logloom.operators import evaluate as E
from logloom.operators.occupancy import pool_occupancy


def distances(left, right, *measures):
    series = [pd.Series([np.array(list(x), dtype=object) for x in side]) for side in (left, right)]
    timed = [[pd.Series([np.array(x) for x in side]) for side in m] for m in measures]
    return distance.distances(*distance._sequences(*series, *timed)).tolist()


def similarities(left, right, *measures):
    longer = [max(len(a), len(b), 1) for a, b in zip(left, right)]
    return [1 - d / n for d, n in zip(distances(left, right, *measures), longer)]


@pytest.mark.parametrize("a, b, d", [("", "", 0), ("abc", "abc", 0), ("abcd", "acbd", 1), ("ca", "abc", 2), ("", "xy", 2)])
def test_distance(a, b, d):
    assert distances([a, b], [b, a]) == [d, d]


def test_distance_matches_the_builtin_of_another_engine():
    rng, con = random.Random(5), duckdb.connect()
    pairs = [["".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(2)] for _ in range(200)]
    want = [con.execute("SELECT damerau_levenshtein(?, ?)", p).fetchone()[0] for p in pairs]
    assert distances(*zip(*pairs)) == want


@pytest.mark.parametrize("cells", [1, 60, 1 << 18])
def test_distances_match_the_whole_table(monkeypatch, cells):
    """All lengths and alphabets, near and far pairs, with and without measures."""
    monkeypatch.setattr(distance, "BATCH_CELLS", cells)
    r = random.Random(cells)
    left, right = [], []
    for _ in range(120):
        letters = "abcdefgh"[: r.choice([1, 2, 3, 8])]
        a = "".join(r.choices(letters, k=r.randint(0, 25)))
        near = "".join(x for x in a if r.random() < 0.8)
        left.append(a)
        right.append(r.choice([a, near, "".join(r.choices(letters, k=r.randint(0, 25)))]))
    assert distances(left, right) == [plain_edit_distance(a, b) for a, b in zip(left, right)]
    dur, wait = ([[[r.choice([0.0, 1.0, r.random()]) for _ in x] for x in side] for side in (left, right)] for _ in "dw")
    want = [
        plain_edit_distance(
            a, b, lambda i, j, p=p: (abs(dur[0][p][i] - dur[1][p][j]) + abs(wait[0][p][i] - wait[1][p][j])) / 2
        )
        for p, (a, b) in enumerate(zip(left, right))
    ]
    assert distances(left, right, dur, wait) == pytest.approx(want, abs=1e-9)


def test_long_sequences_in_linear_memory():
    """Two sequences whose whole table has 10^10 cells, alike but for their middles."""
    r = random.Random(3)
    a = r.choices("abcdefgh", k=100_000)
    b = a[:50_000] + list("xyzzy") + a[50_003:]
    assert distances([a], [b]) == [5]


def test_similarities():
    assert similarities([[], [1, 2]], [[], [1, 3]]) == [1.0, 0.5]
    dur, wait = ([[0.5, 0.0]], [[0.1, 0.0]]), ([[0.0, 0.0]], [[0.0, 0.0]])
    assert similarities(["ab"], ["ab"], dur, wait) == [pytest.approx(1 - 0.2 / 2)]


RECORDS = (
    "pref_size int, ac_pred array<int>, ac_expect array<int>, rl_pred array<int>, rl_expect array<int>,"
    "dur_pred array<double>, dur_expect array<double>, wait_pred array<double>, wait_expect array<double>"
)


def test_suffix_scores(spark):
    rows = spark.createDataFrame(
        [
            (1, [1, 2], [1, 2], [1], [2], [5.0], [1.0, 1.0], [0.0], [0.0]),
            (1, [1, 2], [2, 1], [1], [1], [1.0], [4.0], [0.0], [2.0]),
            (2, [], [], [3], [3, 3], [], [1.5], [], []),
        ],
        RECORDS,
    )
    assert rows_of(E.suffix_similarity(rows), "feature", "pref_size", "mean") == [
        ("ac", 1, 0.75), ("ac", 2, 1.0), ("rl", 1, 0.5), ("rl", 2, 0.5),
    ]
    assert rows_of(E.mae_suffix(rows), "feature", "pref_size", "mean") == [
        ("dur", 1, 3.0), ("dur", 2, 1.5), ("wait", 1, 1.0), ("wait", 2, 0.0),
    ]


def test_next_scores(spark):
    rows = spark.createDataFrame(
        [(1, 1, 2, 3, 1.0, 4.0), (2, 1, 3, 3, 2.0, 2.0)],
        "ac_pred int, ac_expect int, rl_pred int, rl_expect int, tm_pred double, tm_expect double",
    )
    assert rows_of(E.accuracy(rows), "feature", "accuracy") == [("ac", 0.5), ("rl", 0.5)]
    scores = E.mae_next(rows)
    assert rows_of(scores, "feature", "mae") == [("tm", 1.5)]
    assert E.mean_metric(scores, "mae").first()["mean"] == 1.5
    described = E.describe(scores, {"n_size": 5, "index_ac": "x", "activity": "y"})
    assert described.columns == ["feature", "mae", "n_size"]


def log_of(make_log, traces):
    rows = []
    for i, trace in enumerate(traces):
        rows += [(f"c{i:02d}", t, "u", 10 * j, 10 * j + 5 + i) for j, t in enumerate(trace)]
    return make_log(rows)


def test_equal_logs(make_log):
    log = log_of(make_log, ["AB", "ABC", "A"])
    want = {"tsd": 1.0, "day_hour_emd": 0.0, "log_mae": 0.0, "dl": 1.0, "mae": 0.0}
    runs = log.withColumn("run_num", F.lit(0))
    assert dict(rows_of(E.compare_logs(log, runs), "metric", "sim_val")) == want


def test_log_distances(make_log):
    left, right = log_of(make_log, ["AB", "AB", "C"]), log_of(make_log, ["AB", "C", "ABD"])
    # AB and C are paired with their equals, the second AB with ABD
    assert E.control_flow_similarity(left, right).first()[0] == pytest.approx((2 + 2 / 3) / 3)
    cycles = [[15, 16, 7], [15, 6, 27]]
    want = sum(abs(a - b) for a, b in zip(*map(sorted, cycles))) / 3
    assert E.cycle_mae(left, right).first()[0] == pytest.approx(want)
    assert E.log_mae(left, right).first()[0] == pytest.approx(abs(38 - 48) / 3)


def test_unpaired_cases_count_as_zero(make_log):
    left, right = log_of(make_log, ["AB", "AB"]), log_of(make_log, ["AB"])
    assert E.control_flow_similarity(left, right).first()[0] == 0.5
    assert E.timed_string_similarity(left, right).first()[0] == 0.5


def test_timed_similarity_sees_durations(make_log):
    left = make_log([("a", "A", "u", 0, 10), ("b", "B", "u", 0, 4)])
    right = make_log([("a", "A", "u", 0, 5), ("b", "B", "u", 0, 4)])
    # durations 1.0 and 0.5 of the largest: half of the difference is the cost
    assert E.timed_string_similarity(left, right).first()[0] == pytest.approx((0.75 + 1) / 2)


def test_histogram_distance(make_log):
    left = make_log([("a", "A", "u", 0, 1)])  # Monday 8:00
    right = make_log([("a", "A", "u", 7200, 7201)])  # Monday 10:00
    assert E.day_hour_emd(left, right).first()[0] == pytest.approx(2 / 7)


def test_occupancy(make_log, spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        s = rng.randint(0, 60)
        rows.append((f"c{i}", "A", f"u{i % 4}", s, s + rng.randint(0, 20)))
    log = make_log(rows).withColumn("role", F.when(F.col("user") < "u2", "R1").when(F.col("user") < "u3", "R2"))
    pools = spark.createDataFrame([("R1", 2), ("R2", 1)], "role string, users int")
    got = rows_of(pool_occupancy(log, pools), "event_key", "open_events", "role_busy", "role_share")

    def role(u):
        return {"u0": "R1", "u1": "R1", "u2": "R2"}.get(u)

    for key, open_events, busy, part in got:
        at = rows[key][3]
        running = [r for r in rows if r[3] <= at < r[4]]
        mine = [r for r in running if role(r[2]) == role(rows[key][2])]
        assert (open_events, busy) == (len(running), len(mine))
        size = {"R1": 2, "R2": 1}.get(role(rows[key][2]))
        assert part == (len(mine) / size if size else None)
    assert len(got) == 60


def test_occupancy_of_as_many_roles_as_users(make_log, spark):
    rows = [(f"c{i}", "A", f"u{i % 40}", i % 9, i % 9 + 4) for i in range(200)]
    log = make_log(rows).withColumn("role", F.col("user"))
    pools = spark.createDataFrame([(f"u{i}", 1) for i in range(40)], "role string, users int")
    found = pool_occupancy(log, pools)
    assert "ResolvedHint" not in found._jdf.queryExecution().toString()
    for key, open_events, busy in rows_of(found, "event_key", "open_events", "role_busy"):
        at = rows[key][3]
        running = [r for r in rows if r[3] <= at < r[4]]
        assert (open_events, busy) == (len(running), sum(r[2] == rows[key][2] for r in running))


def test_all_runs_as_each_alone(make_log):
    def generated(run, n):
        rng = random.Random(run)
        rows = [(f"g{i}", rng.choice("ABC"), "u", 10 * i + j, 10 * i + j + rng.randint(1, 9))
                for i in range(n) for j in range(rng.randint(1, 4))]
        return make_log(rows).withColumn("run_num", F.lit(run))

    log = generated(99, 12).drop("run_num")
    runs = [generated(0, 9), generated(1, 12), generated(2, 15)]
    table = E.compare_logs(log, runs[0].unionByName(runs[1]).unionByName(runs[2]))
    got = {(r["run_num"], r["metric"]): r["sim_val"] for r in table.collect()}
    assert len(got) == 15
    for k, run in enumerate(runs):
        for metric, value in E.METRICS.items():
            alone = value(log, run.drop("run_num")).first()["sim_val"]
            assert got[k, metric] == pytest.approx(alone)
