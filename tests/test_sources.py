from datetime import datetime

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from logloom.operators.encode import build_index
from logloom.operators.learners import embeddings
from logloom.sources import logs, runs

CSV = """Case ID,Activity,Resource,start_timestamp,end_timestamp
1,Start,u1,2024-01-01T08:00:00.000,2024-01-01T08:00:00.000
1,"A, first",u1,2024-01-01T08:00:00.5,2024-01-01T08:10:00.250000
2,B,,2024-01-02T08:00:00.000001,2024-01-02T09:00:00.000
"""
XES = """<?xml version="1.0" encoding="UTF-8"?>
<log xmlns="http://www.xes-standard.org/" xes.version="1.0">
  <string key="concept:name" value="sample"/>
  <trace>
    <string key="concept:name" value="1"/>
    <event><string key="concept:name" value="A"/><string key="org:resource" value="u1"/>
      <string key="lifecycle:transition" value="START"/>
      <date key="time:timestamp" value="2024-01-01T08:00:00.000+02:00"/></event>
    <event><string key="concept:name" value="A"/><string key="org:resource" value="u1"/>
      <string key="lifecycle:transition" value="complete"/>
      <date key="time:timestamp" value="2024-01-01T08:05:00.500+02:00"/></event>
  </trace>
  <trace>
    <string key="concept:name" value="2"/>
    <event><string key="concept:name" value="B"/>
      <date key="time:timestamp" value="2024-01-01T09:00:00Z"/></event>
  </trace>
</log>
"""


def test_csv(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(CSV)
    log = logs.read_log(spark, str(path))
    assert rows_of(log, "caseid", "task", "start_timestamp", "end_timestamp") == [
        ("1", "A, first", datetime(2024, 1, 1, 8, 0, 0, 500000), datetime(2024, 1, 1, 8, 10, 0, 250000)),
        ("2", "B", datetime(2024, 1, 2, 8, 0, 0, 1), datetime(2024, 1, 2, 9)),
    ]
    logs.write_log(log, str(tmp_path / "test"))
    back = logs.read_test_log(spark, str(tmp_path / "test"))
    columns = ("caseid", "task", "start_timestamp", "end_timestamp", "event_key")
    assert rows_of(back, *columns[:4]) == rows_of(log, *columns[:4])
    assert back.where("user is null").count() == 1


def test_stale_columns_go_only_together(spark):
    both = spark.createDataFrame([(1, 2, 3)], ["a", "Unnamed: 0", "role"])
    assert logs.drop_stale_columns(both).columns == ["a"]
    assert logs.drop_stale_columns(both.drop("Unnamed: 0")).columns == ["a", "role"]


def test_patterns():
    assert logs.spark_pattern("%Y-%m-%dT%H:%M:%S.%f") == "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    with pytest.raises(ValueError):
        logs.spark_pattern("%Q")


def test_xes(spark, tmp_path):
    path = tmp_path / "log.xes"
    path.write_text(XES)
    rows = logs.read_xes(spark, str(path))
    assert rows.count() == 3
    log = logs.pair_lifecycle(rows)
    assert rows_of(log.fillna("-", ["user"]), "caseid", "task", "user", "start_timestamp", "end_timestamp") == [
        ("1", "A", "u1", datetime(2024, 1, 1, 6), datetime(2024, 1, 1, 6, 5, 0, 500000)),  # in UTC
        ("2", "B", "-", datetime(2024, 1, 1, 9), datetime(2024, 1, 1, 9)),
    ]
    assert logs.complete_events(rows).count() == 2


def test_pairing_is_by_rank(spark):
    at = [datetime(2024, 1, 1, h) for h in range(6)]
    rows = [("c", "A", "u", e, at[h]) for e, h in (("start", 0), ("start", 1), ("complete", 2), ("complete", 3), ("complete", 5))]
    df = spark.createDataFrame(rows, "caseid string, task string, user string, event_type string, timestamp timestamp_ntz")
    assert rows_of(logs.pair_lifecycle(df), "start_timestamp", "end_timestamp") == [
        (at[0], at[2]), (at[1], at[3]), (at[5], at[5]),
    ]


@pytest.fixture(scope="module")
def indexes(spark):
    log = spark.createDataFrame([("A", "x"), ("B", "x"), ("B", "y")], "task string, role string")
    return log, build_index(log, "task"), build_index(log, "role")


def test_parameters(spark, tmp_path, indexes):
    _, ac, rl = indexes
    path = str(tmp_path / "parameters")
    args = {"dur": {"max_value": 0.1 + 0.2}, "wait": {"max_value": 7.0}}
    runs.write_parameters(path, {"n_size": 5, "activity": "pred_log"}, False, 9, args, ac, rl)
    back = runs.read_parameters(spark, path)
    assert back.settings == {"n_size": "5"} and back.scale_args == args
    assert (back.max_trace_size, back.one_timestamp) == (9, False)
    assert rows_of(back.activities.table, "idx", "value") == rows_of(ac.table, "idx", "value")
    assert back.roles.end == rl.end


def test_embedding_tables(spark, tmp_path, indexes):
    log, ac, rl = indexes
    coded = log.withColumns({
        "ac_index": (F.ascii("task") - 64), "rl_index": (F.ascii("role") - 119),
    })
    vectors, _ = embeddings(coded, ac, rl)
    assert vectors.count() == ac.size
    path = str(tmp_path / "emb")
    runs.write_embedding(vectors.withColumn("name", F.when(F.col("idx") == 1, "other").otherwise(F.concat(F.lit(" "), "name"))), path)
    back = runs.read_embedding(spark, path, ac)
    assert rows_of(back, "idx", "name") == [(0, "start"), (2, "B"), (3, "end")]


def test_trials_are_appended(spark, tmp_path):
    path = str(tmp_path / "trials")
    row = (5, "max", 0.5, "val_loss", "ok", runs.scale_args_json({"dur": {"max_value": 2.0}}), "t1")
    trials = spark.createDataFrame([row], runs.TRIALS)
    runs.append_trials(trials, path)
    runs.append_trials(trials.withColumn("output", F.lit("t2")), path)
    back = runs.read_trials(spark, path)
    assert rows_of(back, "output") == [("t1",), ("t2",)]
    assert back.first()["scale_args"] == {"dur": {"max_value": 2.0}}


def test_only_committed_parts_are_read(spark, tmp_path):
    from logloom.sources import committed

    path, schema = str(tmp_path / "table"), "x bigint"
    assert committed.read(spark, path, schema).count() == 0
    committed.append(spark.range(3).withColumnRenamed("id", "x"), path)
    spark.range(50).withColumnRenamed("id", "x").write.parquet(f"{path}/parts/lost")  # never committed
    committed.append(spark.range(3, 5).withColumnRenamed("id", "x"), path)
    assert rows_of(committed.read(spark, path, schema)) == [(i,) for i in range(5)]
    committed.append(spark.range(1).withColumnRenamed("id", "x"), path, replace=True)
    assert rows_of(committed.read(spark, path, schema)) == [(0,)]


def test_run_outputs(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1), (1, 2)], "run_num int, x int")
    path, schema = str(tmp_path / "gen"), "run_num int, x int"
    for number in (7, 0):  # the second replaces the first
        runs.write_predictions(rows.withColumn("x", F.col("x") + number), path)
    assert rows_of(runs.read_predictions(spark, path, schema), "run_num", "x") == [(0, 1), (1, 2)]
    runs.write_scores(rows, rows, str(tmp_path / "scores"))
    assert spark.read.parquet(str(tmp_path / "scores" / "test_log")).count() == 2


def test_xes_times_are_utc_and_files_split(spark, tmp_path):
    event = (
        '<event><string key="concept:name" value="A"/><date key="time:timestamp" value="{}"/></event>'
    )
    times = ["2024-10-27T02:30:00.000+02:00", "2024-10-27T02:10:00.000+01:00", "2024-10-27T01:00:00Z"]
    events = "".join(event.format(t) for t in times)
    trace = '<trace><string key="concept:name" value="c{}"/>' + events + "</trace>\n"
    path = tmp_path / "big.xes"
    path.write_text("<log>\n" + "".join(trace.format(k) for k in range(3000)) + "</log>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        rows = logs.read_xes(spark, str(path))
        assert rows.rdd.getNumPartitions() > 1
        got = rows_of(rows.select("caseid", "timestamp"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    at = [datetime(2024, 10, 27, 0, 30), datetime(2024, 10, 27, 1, 0), datetime(2024, 10, 27, 1, 10)]
    assert got == sorted((f"c{k}", t) for k in range(3000) for t in at)


def test_rows_to_pair_are_evaluated_once(spark):
    """Counting and numbering read the pinned rows; what they come from runs once."""
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame(
        [("c", "A", "u", t, f"2024-01-01 08:00:0{k}") for k in range(3) for t in ("start", "complete")],
        "caseid string, task string, user string, event_type string, at string",
    ).withColumn("timestamp", F.to_timestamp_ntz("at")).drop("at")
    assert logs.pair_lifecycle(rows.mapInArrow(passing, rows.schema)).count() == 3
    assert seen.value == 6


def test_offsets_of_xes_times(spark, tmp_path):
    stamps = ["08:00:00Z", "08:00:00.5+02:00", "08:00:00-0130", "08:00:00", "08:00:00.25+14:00"]
    events = "".join(f'<event><date key="time:timestamp" value="2024-01-02T{s}"/></event>' for s in stamps)
    (tmp_path / "log.xes").write_text(f'<log><trace><string key="concept:name" value="c"/>{events}</trace></log>')
    got = [str(r["timestamp"]) for r in logs.read_xes(spark, str(tmp_path / "log.xes")).collect()]
    assert [x[5:19] for x in got] == ["01-02 08:00:00", "01-02 06:00:00", "01-02 09:30:00", "01-02 08:00:00", "01-01 18:00:00"]
