"""Heads with features of their own, and the search over configurations."""

import itertools
import math
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from logloom.operators import positions, resolution
from logloom.operators import routing as R
from logloom.operators.samples import ngram_samples
from logloom.plans.specs import ACTIVITIES, ROLES, TIMES, model_spec

TYPES = ("specialized", "shared_cat", "concatenated")
COLUMNS = ["ac_index", "rl_index", "dur", "wait", "daytime", "weekday"]
ENDS = {"ac_index": 6, "rl_index": 5}
TIMED = ["dur", "wait"]


@pytest.fixture(scope="module")
def samples(skewed_log):
    log = skewed_log.withColumns({
        "ac_index": F.ascii("task") - 64,
        "rl_index": (F.col("event_key") * 5 % 4 + 1).cast("int"),
        "dur": (F.col("event_key") * 13 % 50).cast("double"),
        "wait": (F.col("event_key") * 3 % 7).cast("double"),
        "daytime": (F.col("event_key") * 1000 % 86400).cast("double"),
        "weekday": (F.col("event_key") % 7).cast("int"),
    })
    return ngram_samples(log, COLUMNS, 2, ENDS)


def keys(row, groups, n):
    """Contexts of a head, the longest first."""
    a, r = row["ac_index_prefix"], row["rl_index_prefix"]
    both = {(True, True): [f"{x}:{y}" for x, y in zip(a, r)], (True, False): a, (False, True): r}
    seen = both.get((ACTIVITIES in groups, ROLES in groups))
    beside = [len(bin(int(row[f"{t}_prefix"][-1]))) - 2 for t in TIMED] if TIMES in groups else None
    for k in range(n if seen else 0, -1, -1):
        last = tuple(seen[len(seen) - k :]) if k else ()
        if beside:
            yield k, last, tuple(beside)
        yield k, last, None


def test_heads_look_up_their_own_contexts(samples):
    rows = [r.asDict() for r in samples.collect()]
    seen = set()
    for name in TYPES:
        heads = model_spec(name).heads
        model = R.fit_routed(samples, heads, 2, 6, TIMED, min_support=3)
        got = {(r["caseid"], r["cut"]): r for r in R.predict_routed(samples, model).collect()}
        for head, label in (("ac", "ac_index_next"), ("rl", "rl_index_next")):
            counts = defaultdict(Counter)
            for row in rows:
                for key in keys(row, heads[head], 2):
                    counts[key][row[label]] += 1
            for row in rows:
                key = next(k for k in keys(row, heads[head], 2) if sum(counts[k].values()) >= 3 or k == (0, (), None))
                want = min(counts[key], key=lambda c: (-counts[key][c], c))
                assert got[row["caseid"], row["cut"]][f"{head}_pred"] == want
        medians = defaultdict(list)
        for row in rows:
            if row["ac_index_next"] != 6:
                for key in keys(row, heads["time"], 2):
                    medians[key].append(row["dur_next"])
        for row in rows:
            key = next(k for k in keys(row, heads["time"], 2) if len(medians[k]) >= 3 or k == (0, (), None))
            values = sorted(medians[key])
            assert got[row["caseid"], row["cut"]]["dur_pred"] == values[(len(values) + 1) // 2 - 1]
        seen.add(tuple(sorted((k, r["ac_pred"], r["rl_pred"], r["dur_pred"]) for k, r in got.items())))
    assert len(seen) == len(TYPES)  # the routing changes what is predicted


def test_halving_keeps_the_better_half(spark, samples):
    grid = list(itertools.product(TYPES, [1, 2], ["max", "lognorm"]))
    configs = spark.createDataFrame(grid, "model_type string, n_size int, norm_method string")
    heads = {t: model_spec(t).heads for t in TYPES}
    args = (samples, configs, heads, 6, TIMED)
    whole = {r[:3]: r[3] for r in rows_of(R.routed_losses(samples, *args), "model_type", "n_size", "norm_method", "loss")}
    assert set(whole) == set(grid) and all(v > 0 for v in whole.values())
    rungs = R.successive_halving(samples, *args, shares=(0.5, 1.0), seed=3).collect()
    by_rung = [{(r["model_type"], r["n_size"], r["norm_method"]): r["loss"] for r in rungs if r["rung"] == k} for k in (0, 1)]
    assert len(by_rung[0]) == 12
    assert sorted(by_rung[1]) == sorted(sorted(by_rung[0], key=lambda c: (by_rung[0][c], c))[:6])
    assert all(by_rung[1][c] == pytest.approx(whole[c]) for c in by_rung[1])


def test_tables_that_grow_are_joined_by_shuffle(spark, samples, monkeypatch):
    """Exploded contexts weigh little as files and much as rows: none is broadcast."""
    plans, real = [], R.pin

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return real(df)

    monkeypatch.setattr(R, "pin", seen)
    heads = {t: model_spec(t).heads for t in TYPES}
    configs = spark.createDataFrame([(t, 2, "max") for t in TYPES], "model_type string, n_size int, norm_method string")
    assert R.routed_losses(samples, samples, configs, heads, 6, TIMED).count() == 3
    model = R.fit_routed(samples, heads["concatenated"], 2, 6, TIMED, min_support=3)
    last = R.predict_routed(samples, model)
    plans.append(last._jdf.queryExecution().sparkPlan().toString())
    assert len([p for p in plans if "SortMergeJoin" in p]) >= 4
    assert not [p for p in plans if "Broadcast" in p]


def test_rungs_share_one_pass_over_the_samples(spark, samples, monkeypatch):
    """However many rungs there are, either part's samples are built and read once."""
    plans, real = [], R.pin

    def seen(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return real(df)

    monkeypatch.setattr(R, "pin", seen)
    grid = list(itertools.product(TYPES, [1, 2], ["max"]))
    configs = spark.createDataFrame(grid, "model_type string, n_size int, norm_method string")
    heads = {t: model_spec(t).heads for t in TYPES}
    found = R.successive_halving(samples, samples, configs, heads, 6, TIMED, shares=(0.4, 0.7, 1.0)).collect()
    assert len([p for p in plans if "collect_list" in p]) == 2
    assert Counter(r["rung"] for r in found) == {0: 6, 1: 3, 2: 2}


def losses(spark, train, valid):
    grid = list(itertools.product(TYPES, [1, 2], ["max", "lognorm"]))
    configs = spark.createDataFrame(grid, "model_type string, n_size int, norm_method string")
    rows = R.routed_losses(train, valid, configs, {t: model_spec(t).heads for t in TYPES}, 6, TIMED).collect()
    return {r[:3]: r["loss"] for r in rows}


def test_losses_are_those_of_looking_up_row_by_row(spark, samples):
    train, valid = (samples.where(F.abs(F.xxhash64("caseid")) % 2 == k).cache() for k in (0, 1))
    known, asked = ([r.asDict() for r in x.collect()] for x in (train, valid))
    got = losses(spark, train, valid)
    top = {t: max(r[f"{t}_next"] for r in known if r["ac_index_next"] != 6) for t in TIMED}
    for name, n in itertools.product(TYPES, (1, 2)):
        heads, want = model_spec(name).heads, 0.0
        for head, label in (("ac", "ac_index_next"), ("rl", "rl_index_next")):
            counts = defaultdict(Counter)
            for row in known:
                for key in keys(row, heads[head], n):
                    counts[key][row[label]] += 1
            found = [(next(counts[k] for k in keys(r, heads[head], n) if k in counts), r[label]) for r in asked]
            want += sum(-math.log(max(c[y] / sum(c.values()), R.EPSILON)) for c, y in found) / len(asked)
        values = {t: defaultdict(list) for t in TIMED}
        for row in known:
            if row["ac_index_next"] != 6:
                for key in keys(row, heads["time"], n):
                    for t in TIMED:
                        values[t][key].append(row[f"{t}_next"])
        for row in asked:
            key = next(k for k in keys(row, heads["time"], n) if k in values["dur"])
            for t in TIMED:
                middle = sorted(values[t][key])[(len(values[t][key]) + 1) // 2 - 1]
                actual = 0.0 if row["ac_index_next"] == 6 else row[f"{t}_next"]
                want += abs(actual - middle) / top[t] / 2 / len(asked)
        assert got[name, n, "max"] == pytest.approx(want)


def test_large_contexts_have_the_same_losses(spark, samples, monkeypatch):
    whole, lacking = samples, samples.withColumn("wait_next", F.when(F.col("wait_next") > 2, F.col("wait_next")))
    plain = [losses(spark, x, x) for x in (whole, lacking)]
    monkeypatch.setattr(positions, "HOT_ROWS", 15)
    for fine in (1, 4096):
        monkeypatch.setattr(positions, "FINE", fine)
        for x, want in zip((whole, lacking), plain):
            assert losses(spark, x, x) == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("base", [8, 1 << 30, 1 << 40])
def test_packed_windows_tell_contexts_apart(spark, base):
    """Also where a window needs several numbers."""
    codes = [0, 1, 2, base - 2]
    rows = [(list(a), list(r)) for a in itertools.product(codes, repeat=3) for r in ([0, 1, 1], [1, 0, 1], [0, 1, 0])]
    df = spark.createDataFrame(rows, "ac_index_prefix array<bigint>, rl_index_prefix array<bigint>")
    df = df.withColumns({"_times": F.lit(5).cast("bigint"), "_clock": F.lit(6).cast("bigint")})
    windows = R.Windows.of([df], 3)
    words = df.select("*", *[c for c in windows.words()[:-2]])
    for groups in ((ACTIVITIES,), (ROLES,), (ACTIVITIES, ROLES, TIMES)):
        for (level, family), text in zip(R.families(groups, 3), R.contexts(groups, 3)):
            packed = words.select(windows.context(family, 1).alias("packed"), text.alias("text"))
            found = [(r["packed"], r["text"]["ctx"]) for r in packed.distinct().collect()]
            assert {r["text"]["level"] for r in packed.collect()} == {level}
            assert len({p for p, _ in found}) == len({t for _, t in found}) == len(found)


def test_medians_of_a_stream(monkeypatch):
    """Contexts of one hash are told apart, also across batches; NULL is the smallest value."""
    rows = [(1, 7, 3, 5.0), (1, 8, 1, 2.0), (1, 7, 2, None), (1, 7, 2, 9.0), (2, 7, 2, None)]
    schema = pa.schema([("_group", pa.int64()), ("family", pa.int32()), ("_rungs", pa.int32()), ("dur", pa.float64())])
    batches = [pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(r, schema)], schema=schema) for r in rows]
    for size in (1, 2, 100):
        monkeypatch.setattr(resolution, "ROWS", size)
        out = pa.Table.from_batches(resolution.medians(["family"], ["dur"], 2)(iter(batches)))
        got = sorted(zip(*out.to_pydict().values()))
        assert got == [(7, 0, None, 1, None), (7, 1, 5.0, 3, 5.0), (8, 1, 2.0, 0, None)]
