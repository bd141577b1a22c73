"""The plans for hot groups return what the plain plans return."""

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from logloom.operators import evaluate, positions
from logloom.operators.encode import build_index
from logloom.operators.features import add_calculated_times
from logloom.operators.ngram import time_table
from logloom.operators.samples import ngram_samples, to_traces
from logloom.schema import LogSchema

TIMES = ("event_key", "dur", "wait", "acc_cycle")


def coded(log):
    log = add_calculated_times(log, hot=[])
    code = F.ascii("task") - 64
    return log.withColumns({"ac_index": code, "rl_index": code, "dur_norm": F.col("dur")})


def test_hot_case_is_found(skewed_log, split_hot):
    assert len(positions.hot_groups(skewed_log, ["caseid"])) == 1


def test_calculated_times(skewed_log, split_hot):
    plain = rows_of(add_calculated_times(skewed_log, hot=[]), *TIMES)
    assert rows_of(add_calculated_times(skewed_log), *TIMES) == plain


def test_point_times(skewed_log, split_hot):
    schema = LogSchema(one_timestamp=True)
    columns = ("event_key", "dur", "acc_cycle")
    plain = rows_of(add_calculated_times(skewed_log, schema, hot=[]), *columns)
    assert rows_of(add_calculated_times(skewed_log, schema), *columns) == plain


def test_ngram_samples(skewed_log, split_hot):
    log, columns = coded(skewed_log), ["ac_index", "dur_norm"]
    plain = rows_of(ngram_samples(log, columns, 5, {"ac_index": 6}, hot=[]))
    assert len(plain) == 360 + 61
    assert rows_of(ngram_samples(log, columns, 5, {"ac_index": 6})) == plain


def test_number_rows(skewed_log, split_hot):
    order = ["start_timestamp", "event_key"]
    plain = rows_of(positions.number_rows(skewed_log, ["caseid"], order, hot=[]), "event_key", "pos")
    split = positions.number_rows(skewed_log, ["caseid"], order)
    assert rows_of(split, "event_key", "pos") == plain


def test_global_rank_and_running_totals(spark, split_hot):
    df = spark.range(200).select(F.col("id"), (F.col("id") * 7 % 13).alias("n"))
    ranked = positions.global_rank(df, [F.desc("id")], "rank", 200)
    assert all(r["rank"] == 200 - r["id"] for r in ranked.collect())
    df = df.withColumn("g", (F.col("id") % 10 < 7).cast("int"))
    upto, totals = {}, {0: 0, 1: 0}
    for i in range(200):
        g = int(i % 10 < 7)
        upto[i] = totals[g]
        totals[g] += i * 7 % 13
    got = positions.grouped_running_total(df, "g", ["id"], "n", "before")
    assert {r["id"]: r["before"] for r in got.collect()} == upto


def test_medians(skewed_log, split_hot):
    samples = ngram_samples(coded(skewed_log), ["ac_index", "dur_norm"], 1, {"ac_index": 6})
    samples = samples.withColumnRenamed("dur_norm_next", "dur_next")
    got = {(r["ctx"], r["next"]): r["dur"] for r in time_table(samples, ["dur"], 1).collect()}
    groups = {}
    for r in samples.collect():
        for ctx in ("", str(r["ac_index_prefix"][0])):
            groups.setdefault((ctx, r["ac_index_next"]), []).append(r["dur_next"])
    assert got == {g: sorted(v)[(len(v) + 1) // 2 - 1] for g, v in groups.items()}


def test_traces_in_parts(skewed_log, split_hot, monkeypatch):
    from logloom.operators import samples

    log, ends = coded(skewed_log), {"ac_index": 6}
    whole = {r["caseid"]: r["ac_index"] for r in to_traces(log, ["ac_index"], ends).collect()}
    monkeypatch.setattr(samples, "SEGMENT_ROWS", 16)
    parts = {}
    for r in to_traces(log, ["ac_index"], ends).orderBy("caseid", "part").collect():
        parts.setdefault(r["caseid"], []).append(r["ac_index"])
    assert len(parts["hot"]) == 8
    assert {c: sum(p, []) for c, p in parts.items()} == whole


def test_couplings_over_slices(spark, monkeypatch):
    left = spark.createDataFrame([(i, 1 + i * 5 % 7) for i in range(40)], "v bigint, n bigint")
    right = spark.createDataFrame([(3 * i, 1 + i * 3 % 5) for i in range(50)], "v bigint, n bigint")

    def line(df):
        return [v for v, n in sorted(map(tuple, df.collect())) for _ in range(n)]

    monkeypatch.setattr(evaluate, "SLICE_MASS", 10)
    pairs = evaluate.couple(left, right, ["v"], ["v"])
    got = sorted((r["l"]["v"], r["r"]["v"]) for r in pairs.collect() for _ in range(r["mass"]))
    assert got == sorted(zip(line(left), line(right)))


def test_index_of_many_values(spark, split_hot):
    log = spark.range(300).select(F.format_string("v%04d", F.col("id") % 150).alias("task"))
    index = build_index(log, "task")
    got = dict(map(tuple, index.table.collect()))
    assert index.values == 150 and got["start"] == 0 and got["end"] == 151
    assert [got[f"v{i:04d}"] for i in range(150)] == list(range(1, 151))


def test_other_partition_counts(spark, skewed_log, split_hot):
    want = rows_of(add_calculated_times(skewed_log, hot=[]), *TIMES)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "8", "37"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows_of(add_calculated_times(skewed_log), *TIMES) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_null_case_survives_the_hot_plan(skewed_log, split_hot):
    """Plain and hot plan agree when the hot case, or a small one, has no id."""
    from pyspark.sql import functions as F

    from logloom.operators.features import add_calculated_times
    from logloom.operators.positions import hot_groups

    for gone in ("hot", "c7"):
        log = skewed_log.withColumn("caseid", F.when(F.col("caseid") != gone, F.col("caseid")))
        assert hot_groups(log, ["caseid"])
        hot = add_calculated_times(log)
        assert hot.count() == log.count()
        named = add_calculated_times(log.fillna("none", ["caseid"]))
        assert rows_of(hot.fillna("none", ["caseid"])) == rows_of(named)


def test_all_hot_groups_are_found(spark, monkeypatch):
    from logloom.operators import positions

    monkeypatch.setattr(positions, "HOT_ROWS", 1)
    groups = spark.range(3000).selectExpr("id div 2 as g")
    assert len(positions.hot_groups(groups, ["g"])) == 1500


@pytest.mark.parametrize("hot_rows", [50, 1_000_000])
def test_medians_come_with_the_size_of_their_group(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(positions, "HOT_ROWS", hot_rows)
    rows = [("a", float(i * 7 % 101)) for i in range(101)] + [("b", 2.0), ("b", 1.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["v"], r["n"]) for r in positions.grouped_medians(df, ["g"], ["v"], size="n").collect()}
    assert got == {"a": (50.0, 101), "b": (1.0, 2), None: (4.0, 1)}


def test_rows_of_hot_groups_are_read_once_a_column(spark, monkeypatch):
    monkeypatch.setattr(positions, "HOT_ROWS", 50)
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(300).selectExpr("cast(id % 2 as int) as g", "id * 7 % 300 as v", "id * 11 % 300 as w")
    df = rows.mapInArrow(passed, rows.schema)
    hot = [r["h"] for r in spark.range(2).select(F.xxhash64(F.col("id").cast("int")).alias("h")).collect()]
    got = positions.grouped_medians(df, ["g"], ["v", "w"], hot, "n").collect()
    assert sorted(map(tuple, got)) == [(0, 148, 148, 150), (1, 149, 149, 150)]
    assert read.value <= 3 * 300  # also by the plan of the ordinary groups
