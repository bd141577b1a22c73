import random
from datetime import timedelta

import numpy as np
import pytest
from helpers import T0, rows_of
from pyspark.sql import functions as F

from logloom.functions.draws import uniform
from logloom.operators import ngram as G
from logloom.operators import trials as X
from logloom.operators import walks as K
from logloom.operators.encode import CategoryIndex
from logloom.operators.learners import FACTOR_ROUNDS, factor_embeddings
from logloom.operators.samples import ngram_samples
from logloom.plans import prediction as P
from logloom.plans.specs import FAMILIES, SPECS, model_spec
from logloom.plans.training import fit, prepare, training_samples, vectorize
from logloom.schema import LogSchema

POINT = LogSchema(one_timestamp=True)
N = 2


def random_log(make_log, seed=1, cases=40):
    rng = random.Random(seed)
    rows, t = [], 0
    for c in range(cases):
        t += rng.randint(1, 50)
        clock = t
        for _ in range(rng.randint(1, 7)):
            start = clock + rng.randint(0, 4)
            clock = start + rng.randint(0, 9)
            rows.append((f"c{c:02d}", rng.choice("AAB" if clock % 2 else "BCD"), f"u{rng.randint(0, 4)}", start, clock))
    return make_log(rows).withColumn("role", F.concat(F.lit("R"), F.substring("user", 2, 1)))


@pytest.fixture(scope="module")
def ready(make_log):
    return prepare(random_log(make_log), method="trace")


@pytest.fixture(scope="module")
def model(ready):
    return fit(ready, N, min_support=2)


@pytest.fixture(scope="module")
def counts(ready):
    """Brute-force counts: context -> next -> rows of training labels."""
    out = {}
    for r in training_samples(ready, N).collect():
        window = r["ac_index_prefix"]
        for k in range(N + 1):
            ctx = ",".join(map(str, window[N - k :]))
            out.setdefault(ctx, {}).setdefault(r["ac_index_next"], []).append(r)
    return out


def supported(counts, window, least=2):
    for k in (2, 1, 0):
        ctx = ",".join(map(str, window[N - k :]))
        if k == 0 or sum(map(len, counts.get(ctx, {}).values())) >= least:
            return ctx


def best(counts, window):
    options = counts[supported(counts, window)]
    return min(options, key=lambda c: (-len(options[c]), c))


def test_states_hold_the_counts(model, counts):
    for s in model.states.collect():
        want = {c: len(v) for c, v in counts[s["ctx"]].items()}
        assert {c["next"]: c["n"] for c in s["ac"]} == want
        assert s["total"] == sum(want.values()) == s["ac"][-1]["upto"]
        assert s["best"]["next"] == min(want, key=lambda c: (-want[c], c))
        for c in s["ac"]:
            labels = sorted(r["dur_norm_next"] for r in counts[s["ctx"]][c["next"]])
            assert c["dur"] == labels[(len(labels) + 1) // 2 - 1]
            history = ([0] * N + [int(v) for v in s["ctx"].split(",") if v] + [c["next"]])[-N:]
            if c["next"] == model.end:
                assert c["to"] is None
            elif s["k"] == N:
                assert c["to"] == supported(counts, history)


def test_probabilities_sum_to_one(ready):
    table = G.ngram_table(training_samples(ready, N), "ac_index_next", N)
    sums = table.groupBy("ctx").agg(F.sum("p").alias("p"))
    assert all(r["p"] == pytest.approx(1) for r in sums.collect())


def test_ties_go_to_the_smallest_index(spark):
    choices = F.array(*[F.struct(F.lit(i).alias("next"), F.lit(n).alias("n")) for i, n in ((1, 2), (3, 5), (4, 5))])
    assert spark.range(1).select(G.likeliest(choices).alias("c")).first()["c"]["next"] == 3


def test_next_event_backs_off(ready, model, counts):
    rows = P.next_event_records(ready, model).collect()
    assert rows
    for r in rows:
        assert r["ac_pred"] == best(counts, r["ac_prefix"])


def test_whole_prefixes_predict_the_same(ready, model):
    columns = ("caseid", "cut", "ac_pred", "rl_pred", "dur_pred", "ac_expect", "dur_expect")
    window = rows_of(P.next_event_records(ready, model), *columns)
    whole = P.next_event_records(ready, model, whole_prefix=True)
    assert rows_of(whole, *columns) == window
    assert all(len(r["ac_prefix"]) == r["pref_size"] for r in whole.collect())


def test_suffixes_follow_the_best_choice(ready, model, counts):
    rows = P.suffix_records(ready, model).collect()
    assert rows
    for r in rows:
        window = ([0] * N + r["ac_prefix"])[-N:]
        want = []
        while len(want) < ready.max_trace_size - 1 and (not want or want[-1] != model.end):
            want.append(best(counts, window))
            window = [*window[1:], want[-1]]
        assert r["ac_pred"] == want
        assert len(r["dur_pred"]) == len(r["rl_pred"]) == len(want)


@pytest.mark.parametrize("steps", [1, 2, 7, 50, 1000])
def test_paths_are_as_long_as_the_model(spark, steps):
    """Chains that end, chains that run into cycles, cycles alone; any number of steps."""
    from logloom.operators.walks import likeliest_paths, unrolled

    to = {f"c{i}": f"c{i + 1}" for i in range(9)} | {"c9": None}  # ends
    to |= {f"t{i}": f"t{i + 1}" for i in range(5)} | {"t5": "r0"} | {f"r{i}": f"r{(i + 1) % 3}" for i in range(3)}
    to |= {"self": "self", "b1": "t2", "b2": "b1"}
    number = {s: i for i, s in enumerate(sorted(to))}
    rows = [(s, (number[s], t, float(number[s])), -number[s]) for s, t in to.items()]
    states = spark.createDataFrame(rows, "ctx string, best struct<next: int, to: string, dur: double>, best_rl int")
    paths = likeliest_paths(G.NgramModel(states, 2, 99, ("dur",)), steps)
    assert paths.agg(F.max(F.size("ac"))).first()[0] <= len(to)
    got = {
        r["state"]: (r["ac"], r["rl"], r["dur"])
        for r in paths.select("state", *[unrolled(F.col(c), F.col("loop"), steps).alias(c) for c in ("ac", "rl", "dur")]).collect()
    }
    for state in to:
        want, at = [], state
        while at is not None and len(want) < steps:
            want.append(number[at])
            at = to[at]
        assert got[state] == (want, [-x for x in want], [float(x) for x in want])


def test_remaining_time(ready, model):
    rows = P.suffix_records(ready, model)
    for r in rows.withColumn("t", P.remaining_time(rows)).collect():
        assert r["t"] == pytest.approx(sum(r["dur_pred"]) + sum(r["wait_pred"]))


def test_sampled_predictions_repeat(ready, model):
    first = rows_of(P.suffix_records(ready, model, G.RANDOM_CHOICE, seed=3), "caseid", "cut", "ac_pred")
    again = rows_of(P.suffix_records(ready, model, G.RANDOM_CHOICE, seed=3), "caseid", "cut", "ac_pred")
    other = rows_of(P.suffix_records(ready, model, G.RANDOM_CHOICE, seed=4), "caseid", "cut", "ac_pred")
    assert first == again != other
    with pytest.raises(ValueError):
        P.next_event_records(ready, model, "Arg Max")


def test_draws_follow_the_counts(spark):
    choices = F.array(*[
        F.struct(F.lit(c).alias("next"), F.lit(n).alias("n"), F.lit(u).alias("upto"))
        for c, n, u in ((1, 1, 1), (2, 3, 4))
    ])
    drawn = spark.range(4000).select(G.drawn(choices, uniform(F.col("id"), "s"))["next"].alias("c"))
    share = drawn.where("c = 2").count() / 4000
    assert 0.72 < share < 0.78
    left = spark.range(1).select(G.without(choices, 1).alias("c")).first()["c"]
    assert [tuple(c) for c in left] == [(2, 3, 3)]


def test_a_draw_is_made_once_a_row(spark):
    """Not once for each choice: a Python function may not even stand there."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def draw(i):
        calls.add(1)
        return i / 40

    choices = F.sequence(F.lit(1), F.lit(10))
    choices = F.transform(choices, lambda c: F.struct(c.alias("next"), F.lit(1).alias("n"), c.alias("upto")))
    rows = spark.range(40).select("id", G.drawn(choices, draw("id"))["next"].alias("c")).collect()
    assert [r["c"] for r in rows] == [r["id"] * 10 // 40 + 1 for r in rows]
    assert calls.value == 40


@pytest.mark.parametrize("variant", G.VARIANTS)
def test_generated_log(ready, model, variant):
    log = P.generated_log(ready, model, variant, seed=2).orderBy("caseid", "pos").collect()
    cases = {}
    for r in log:
        cases.setdefault(r["caseid"], []).append(r)
    n = ready.test.select("caseid").distinct().count()
    assert sorted(cases) == [f"Case{i:0{len(str(n))}d}" for i in range(n)]
    start = ready.test.agg(F.min("start_timestamp")).first()[0]
    for events in cases.values():
        assert [r["pos"] for r in events] == list(range(len(events)))
        assert len(events) < ready.max_trace_size
        clock = start
        for r in events:
            assert r["task"] not in ("start", "end")
            assert abs(r["start_timestamp"] - clock - timedelta(seconds=r["wait"])) < timedelta(microseconds=2)
            assert abs(r["end_timestamp"] - r["start_timestamp"] - timedelta(seconds=r["dur"])) < timedelta(microseconds=2)
            clock = r["end_timestamp"]


def test_generated_log_with_context(make_log):
    ready = prepare(random_log(make_log), "shared_cat_cx", method="trace")
    log = P.generated_log(ready, fit(ready, N), seed=2, context=True)
    starts = log.where("task = 'start'")
    assert starts.count() == ready.test.select("caseid").distinct().count()
    assert starts.where("pos <> 0").count() == 0
    assert log.where("task = 'end'").count() > 0


def test_generated_point_log(make_log):
    log = random_log(make_log).drop("start_timestamp")
    ready = prepare(log, schema=POINT, norm_method="max", method="trace")
    got = P.generated_log(ready, fit(ready, N), seed=2)
    start = ready.test.agg(F.min("end_timestamp")).first()[0]
    assert {r["end_timestamp"] for r in got.where("pos = 0").collect()} == {start}
    assert {"tbtw_raw", "tbtw"} < set(got.columns)
    records = P.next_event_records(ready, fit(ready, N))
    assert {"tm_prefix", "tm_expect", "tm_pred"} < set(records.columns)


def test_running_timestamps(spark):
    log = spark.createDataFrame([("c", 0, 5.0, 1.0), ("c", 1, 2.0, 3.0)], "caseid string, pos int, dur double, wait double")
    got = K.running_timestamps(log, T0, LogSchema())
    assert [tuple(r) for r in got.orderBy("pos").select("start_timestamp", "end_timestamp").collect()] == [
        (T0 + timedelta(seconds=1), T0 + timedelta(seconds=6)),
        (T0 + timedelta(seconds=9), T0 + timedelta(seconds=11)),
    ]
    point = K.running_timestamps(log, T0, POINT).orderBy("pos")
    assert [r["end_timestamp"] for r in point.collect()] == [T0, T0 + timedelta(seconds=2)]


def test_runs_are_numbered(ready, model):
    rows = P.predictions(ready, model, "pred_log", G.RANDOM_CHOICE, rep=2)
    assert rows_of(rows.select("run_num").distinct()) == [(0,), (1,)]
    assert rows_of(rows.where("run_num = 0").drop("run_num")) != rows_of(rows.where("run_num = 1").drop("run_num"))
    with pytest.raises(ValueError):
        P.predictions(ready, model, "other", G.ARG_MAX)


def test_tasks_are_sampled_and_scored(make_log, model, ready):
    context = prepare(random_log(make_log), "shared_cat_cx", method="trace")
    assert {"weekday_prefix", "daytime_norm_suffix"} <= set(P.task_samples(context, "pred_sfx").columns)
    for task in P.TASKS:
        records = P.predictions(ready, model, task, G.ARG_MAX)
        scores = P.evaluate(ready, task, records)
        assert all(table.count() > 0 for table in scores.values())
    with pytest.raises(ValueError):
        P.task_samples(ready, "pred_log")
    with pytest.raises(ValueError):
        P.evaluate(ready, "other", None)


def test_hot_groups_fit_the_same_states(skewed_log, request):
    log = skewed_log.withColumn("role", F.col("user"))
    columns = ("ctx", "k", "total", "ac", "rl", "best")
    plain = rows_of(fit(prepare(log, method="trace"), N).states, *columns)
    request.getfixturevalue("split_hot")
    again = prepare(log, method="trace")
    assert len(again.hot) == 1
    assert rows_of(fit(again, N).states, *columns) == plain


def test_specs():
    assert len(SPECS) == 11 and model_spec("shared_cat_gru_cx").additional_columns == ("daytime", "weekday")
    assert model_spec("specialized_gru").heads == model_spec("specialized").heads
    assert all(name in SPECS for family in FAMILIES.values() for name in family)
    with pytest.raises(ValueError):
        model_spec("other")


def test_vectorizers(make_log, ready):
    assert "weekday_prefix" not in vectorize(ready, N).columns
    context = prepare(random_log(make_log), "concatenated_cx", method="trace")
    assert {"weekday_prefix", "daytime_norm_next"} <= set(vectorize(context, N).columns)
    gan = prepare(random_log(make_log), "simple_gan", method="trace")
    assert rows_of(vectorize(gan, N).select("label").distinct()) == [(0,), (1,)]


def test_trials(spark, make_log):
    raw = prepare(random_log(make_log), norm_method=None, method="trace")
    names = {"dur_norm_next": "dur_next", "wait_norm_next": "wait_next"}
    parts = [
        ngram_samples(x, raw.columns, N, raw.ends).withColumnsRenamed(names) for x in (raw.train, raw.test)
    ]
    grid = X.config_grid(spark, {"n_size": [1, 2], "norm_method": ["max", "normal"]})
    trials = X.config_losses(*parts, raw.activities.end, grid)
    losses = {(r["n_size"], r["norm_method"]): r["loss"] for r in trials.collect()}
    assert len(losses) == 4 and min(losses.values()) > 0
    best = X.best_trial(trials).first()
    assert best["loss"] == min(losses.values()) and best["status"] == "ok"
    assert X.matching_result(trials, trials).first()["output"] == best["output"]
    assert X.sample_configs(grid, 3, seed=1).count() == 3
    assert rows_of(X.sample_configs(grid, 3, seed=1)) == rows_of(X.sample_configs(grid, 3, seed=1))
    failed = trials.withColumn("status", F.lit("fail"))
    assert X.successful(failed).count() == 0


def test_factor_embeddings(spark):
    """The dot products are those of the table projected by plain subspace iteration."""
    r = random.Random(5)
    pairs = [(min(a, r.randint(1, 6)), b) for a in range(1, 7) for b in range(1, 6) for _ in range(r.randint(0, 9))]
    log = spark.createDataFrame(pairs, "ac_index int, rl_index int")
    names = [("start", 0), *[(f"v{i}", i) for i in range(1, 7)], ("end", 7)]
    index = [
        CategoryIndex(spark.createDataFrame([*names[:n], ("end", n)], "value string, idx int"), n - 1) for n in (7, 6)
    ]
    table = np.zeros((8, 7))
    for a, b in pairs:
        table[a, b] += 1
    table = np.log1p(table)
    v = np.cos(np.outer(np.arange(7), np.arange(3))) * (np.arange(7) % 6 > 0)[:, None]
    for _ in range(FACTOR_ROUNDS):
        q, triangle = np.linalg.qr(table.T @ (table @ v))
        v = q * np.sign(np.diag(triangle))
    got = [np.array([x.vec for x in f.orderBy("idx").collect()]) for f in factor_embeddings(log, *index)]
    assert got[0].shape == (8, 3) and got[1].shape == (7, 3)
    assert np.allclose(got[0] @ got[1].T, table @ v @ v.T, atol=1e-5)
    assert not got[0][[0, 7]].any() and not got[1][[0, 6]].any()

    # one role: a single dimension, the other vectors are zero; an empty log has zeros only
    single = [np.array([x.vec for x in f.collect()]) for f in factor_embeddings(log.where("rl_index = 2"), *index)]
    assert (np.abs(single[0]).sum(axis=0) > 0).tolist() == [True, False, False]
    empty = [np.array([x.vec for x in f.collect()]) for f in factor_embeddings(log.where("false"), *index)]
    assert empty[0].shape == (8, 3) and not empty[0].any() and not empty[1].any()


def test_walks_write_each_event_once(ready, spark, monkeypatch):
    """Blocks of the log hold their own steps only; salted states give the same walks."""
    model = fit(ready, n=N)
    first = model.states.orderBy(F.element_at("ac", -1)["upto"].desc(), "ctx").first()["ctx"]
    walkers = spark.range(50).withColumn("state", F.lit(first))
    found = []
    for steps, salts, start in ((1, 1, []), (4, 32, [first]), (3, 5, [])):
        monkeypatch.setattr(K, "STEPS_PER_PIN", steps)
        monkeypatch.setattr(K, "SALTS", salts)
        walked = K.walk(walkers, model, 10, G.RANDOM_CHOICE, [F.col("id")], "s", False, start=start)
        found.append(rows_of(walked.select("id", "pos", "e.ac", "e.rl"), "id", "pos", "ac", "rl"))
    assert found[0] == found[1] == found[2]
    places = {i: [p for j, p, _, _ in found[0] if j == i] for i in range(50)}
    assert all(places[i] == list(range(len(places[i]))) and places[i] for i in places)
    assert max(map(len, places.values())) > 4
    assert K.walk(walkers.limit(0), model, 10, G.RANDOM_CHOICE, [F.col("id")], "s", False).count() == 0
