import re

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from logloom.functions.arrays import one_hot, pad_last, push
from logloom.operators import samples as X
from logloom.operators.encode import build_index, decode, encode
from logloom.operators.pairs import (
    embedding_dimension, negative_samples, observed_pairs, unobserved_pairs,
)

ENDS = {"ac_index": 4}


@pytest.fixture(scope="module")
def coded(tiny_log):
    log = encode(tiny_log, build_index(tiny_log, "task"), "task", "ac_index")
    return log.withColumn("dur_norm", (F.col("event_key") + 1) / 10)


def test_index(tiny_log):
    index = build_index(tiny_log, "task")
    assert rows_of(index.table, "idx", "value") == [
        (0, "start"), (1, "A"), (2, "B"), (3, "C"), (4, "end"),
    ]
    assert (index.end, index.size) == (4, 5)


def test_decode_inverts_encode(coded, tiny_log):
    back = decode(coded, build_index(tiny_log, "task"), "ac_index", "label")
    assert back.where("label <> task").count() == 0 and back.count() == 5


def test_missing_role_has_its_own_label(spark):
    log = spark.createDataFrame([("Role 1",), (None,)], "role string")
    index = build_index(log, "role")
    assert rows_of(encode(log, index, "role", "rl_index"), "rl_index") == [(1,), (2,)]


def test_trace_series(coded):
    got = rows_of(X.to_traces(coded, ["ac_index", "dur_norm"], ENDS), "caseid", "ac_index", "dur_norm")
    assert got == [
        ("c1", [0, 1, 2, 3, 4], [0.0, 0.1, 0.2, 0.3, 0.0]),
        ("c2", [0, 1, 3, 4], [0.0, 0.4, 0.5, 0.0]),
    ]


def test_ngrams_are_padded_and_end(coded):
    got = rows_of(X.ngram_samples(coded, ["ac_index"], 2, ENDS), "caseid", "cut", "ac_index_prefix", "ac_index_next")
    assert got == [
        ("c1", 0, [0, 0], 1), ("c1", 1, [0, 1], 2), ("c1", 2, [1, 2], 3), ("c1", 3, [2, 3], 4),
        ("c2", 0, [0, 0], 1), ("c2", 1, [0, 1], 3), ("c2", 2, [1, 3], 4),
    ]


def test_window_longer_than_the_trace(coded):
    got = X.ngram_samples(coded.where("caseid = 'c2'"), ["dur_norm"], 6, {})
    assert rows_of(got, "cut", "dur_norm_prefix", "dur_norm_next") == [
        (0, [0.0] * 6, 0.4), (1, [0.0] * 5 + [0.4], 0.5), (2, [0.0] * 4 + [0.4, 0.5], 0.0),
    ]


def test_next_event_prefixes_grow(coded):
    got = rows_of(X.next_event_samples(coded, ["ac_index"], ENDS), "caseid", "ac_index_prefix", "ac_index_next")
    assert got == [
        ("c1", [0], 1), ("c1", [0, 1], 2), ("c1", [0, 1, 2], 3), ("c2", [0], 1), ("c2", [0, 1], 3),
    ]
    more = X.next_event_samples(coded, ["ac_index"], ENDS, include_end=True)
    assert more.where("ac_index_next = 4").count() == 2


def test_suffixes_hold_the_end(coded):
    got = rows_of(X.suffix_samples(coded.where("caseid = 'c2'"), ["ac_index"], ENDS),
                  "cut", "ac_index_prefix", "ac_index_suffix")
    assert got == [(0, [0], [1, 3, 4]), (1, [0, 1], [3, 4]), (2, [0, 1, 3], [4])]


@pytest.mark.parametrize("build", [X.suffix_samples, X.next_event_samples])
def test_cases_of_many_parts(skewed_log, split_hot, monkeypatch, build):
    """Cases beyond every bound give the rows of the plain plan."""
    log = skewed_log.withColumns({"ac_index": F.ascii("task") - 64, "dur_norm": F.col("event_key") / 7})
    columns, ends = ["ac_index", "dur_norm"], {"ac_index": 6}
    whole = {r["caseid"]: r for r in log.groupBy("caseid").agg(
        F.sort_array(F.collect_list(F.struct("start_timestamp", "event_key", "ac_index", "dur_norm"))).alias("e")
    ).collect()}
    want = []
    for case, r in whole.items():
        a = [0, *[e["ac_index"] for e in r["e"]], 6]
        d = [0.0, *[e["dur_norm"] for e in r["e"]], 0.0]
        for cut in range(len(a) - 1 - (build is X.next_event_samples)):
            rest = (a[cut + 1 :], d[cut + 1 :]) if build is X.suffix_samples else (a[cut + 1], d[cut + 1])
            want.append((case, cut, a[: cut + 1], d[: cut + 1], *rest))
    second = "suffix" if build is X.suffix_samples else "next"
    names = ["caseid", "cut", *[f"{c}_prefix" for c in columns], *[f"{c}_{second}" for c in columns]]
    for size in (512, 50, 7, 1):
        monkeypatch.setattr(X, "PART_EVENTS", size)
        assert rows_of(build(log, columns, ends), *names) == sorted(want)


def test_parts_of_a_case_are_completed_apart(skewed_log, monkeypatch):
    monkeypatch.setattr(X, "PART_EVENTS", 10)
    log = skewed_log.withColumn("ac_index", F.ascii("task") - 64)
    plan = X.suffix_samples(log, ["ac_index"], {"ac_index": 6})._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\(caseid#\d+, _at#\d+", plan)


def test_sample_counts(skewed_log):
    log = skewed_log.withColumn("ac_index", F.ascii("task") - 64)
    assert X.ngram_samples(log, ["ac_index"], 3, {"ac_index": 6}).count() == 360 + 61
    assert X.next_event_samples(log, ["ac_index"], {"ac_index": 6}).count() == 360
    assert X.suffix_samples(log, ["ac_index"], {"ac_index": 6}).count() == 360 + 61


def test_windows_are_the_padded_prefixes(skewed_log):
    log, ends = skewed_log.withColumn("ac_index", F.ascii("task") - 64), {"ac_index": 6}
    whole = X.next_event_samples(log, ["ac_index"], ends).withColumn(
        "ac_index_prefix", pad_last(F.col("ac_index_prefix"), 4, F.lit(0))
    )
    assert rows_of(X.windowed_samples(log, ["ac_index"], 4, ends, include_end=False)) == rows_of(whole)


def test_arrays(spark):
    row = spark.range(1).select(
        pad_last(F.array(F.lit(1), F.lit(2)), 3, F.lit(0)).alias("padded"),
        pad_last(F.array(*map(F.lit, (1, 2, 3, 4))), 3, F.lit(0)).alias("cut"),
        push(F.array(*map(F.lit, (1, 2, 3))), F.lit(9), 3).alias("pushed"),
        one_hot(F.lit(2), 4).alias("hot"),
    ).first()
    assert tuple(row) == ([0, 1, 2], [2, 3, 4], [2, 3, 9], [0, 0, 1, 0])


def test_stacked_features_put_weekday_last(spark):
    samples = spark.createDataFrame([([0.5, 0.25], [6, 1])], "dur_norm_prefix array<double>, weekday_prefix array<int>")
    tensor = X.stack_features(samples, ["dur_norm", "weekday"]).first()["tensor"]
    assert tensor == [[0.5, 0, 0, 0, 0, 0, 0, 1.0], [0.25, 0, 1.0, 0, 0, 0, 0, 0]]


def test_one_hot_labels(coded):
    rows = X.one_hot_labels(X.ngram_samples(coded, ["ac_index"], 2, ENDS), {"ac_index": 5})
    assert {tuple(r["ac_index_next"]) for r in rows.where("cut = 0").collect()} == {(0, 1, 0, 0, 0)}


def pairs_log(make_log, n):
    log = make_log([(f"c{i}", "A", "u", i, i) for i in range(n)])
    return log.withColumns({"ac_index": F.lit(1), "rl_index": (F.col("event_key") % 2 + 1).cast("int")})


def test_pairs_and_negatives(make_log):
    log = pairs_log(make_log, 10)
    assert rows_of(observed_pairs(log)) == [(1, 5, 1), (1, 5, 2)]
    free = unobserved_pairs(log, 3, 4)
    assert free.count() == 10 and free.where("ac_index = 1 and rl_index in (1, 2)").count() == 0
    rows = negative_samples(log, 3, 4, seed=5)
    assert rows_of(rows.groupBy("label").count()) == [(3, 1), (6, 0)]
    taken = rows_of(rows)
    assert rows_of(negative_samples(log, 3, 4, seed=5)) == taken
    assert rows_of(negative_samples(log, 3, 4, seed=6)) != taken
    bad = rows.where("(label = 1) <> (ac_index = 1 and rl_index in (1, 2))")
    assert bad.count() == 0


@pytest.mark.parametrize("taken", [0, 1, 5, 40, 62, 63])
def test_complement_of_the_observed_pairs(spark, monkeypatch, taken):
    """Runs of unobserved pairs against the grid, also cut into stretches of three ranks."""
    import random

    from logloom.operators import pairs

    monkeypatch.setattr(pairs, "STRETCH", 3)
    monkeypatch.setattr(pairs, "PIECE", 4)
    grid = [(a, r) for a in range(7) for r in range(9)]
    seen = random.Random(taken).sample(grid, taken)
    rows = [(f"c{i}", i, a, r) for i, (a, r) in enumerate([*seen, *seen, (7, 0), (0, 9), (None, 1)])]
    log = spark.createDataFrame(rows, "caseid string, k int, ac_index int, rl_index int")
    runs, size = pairs.gaps(log, 7, 9)
    assert size == 63 - taken and runs.count() <= taken + 1
    free = sorted(set(grid) - set(seen))
    assert rows_of(unobserved_pairs(log, 7, 9)) == free
    plan = unobserved_pairs(log, 7, 9)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "LeftAnti" not in plan
    ranked = [(low, high, shift) for high, low, shift in rows_of(pairs._pieces(runs, 3), "high", "low", "shift")]
    assert sorted(x + s for low, high, s in ranked for x in range(low, high)) == [a * 9 + r for a, r in free]


def test_polarity_and_full_grid(make_log):
    log = pairs_log(make_log, 6)
    zero = negative_samples(log, 3, 4, seed=5, positive_label=0)
    assert rows_of(zero.groupBy("label").count()) == [(2, 0), (4, 1)]
    everything = log.withColumn("rl_index", F.lit(0)).withColumn("ac_index", F.lit(0))
    assert negative_samples(everything, 1, 1, seed=5).where("label = 0").count() == 0


def test_embedding_dimension():
    assert embedding_dimension(5, 4) == 3 and embedding_dimension(16, 1) == 2
