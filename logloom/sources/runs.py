"""Tables of a run: parameters, predictions, metrics, embeddings, trials."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators.encode import CategoryIndex
from logloom.sources import committed

PARAMETERS = (
    "settings map<string,string>, one_timestamp boolean, max_trace_size bigint, "
    "scale_args map<string,map<string,string>>"
)
INDEX = "kind string, idx int, value string"


@dataclass(frozen=True)
class RunParameters:
    settings: dict[str, str]
    one_timestamp: bool
    max_trace_size: int
    scale_args: dict[str, dict[str, float]]
    activities: CategoryIndex
    roles: CategoryIndex


def write_parameters(
    path: str, settings: dict, one_timestamp: bool, max_trace_size: int,
    scale_args: dict, activities: CategoryIndex, roles: CategoryIndex,
) -> None:
    """One row of settings, and the indexes as the tables they are."""
    spark = activities.table.sparkSession
    row = (
        {k: str(v) for k, v in settings.items() if k != "activity"}, one_timestamp, max_trace_size,
        {f: {a: repr(v) for a, v in args.items()} for f, args in scale_args.items()},
    )
    both = [
        index.table.select(F.lit(kind).alias("kind"), F.col("idx").cast("int").alias("idx"), "value")
        for kind, index in (("ac", activities), ("rl", roles))
    ]
    committed.append(both[0].unionByName(both[1]), f"{path}/indexes", replace=True)
    committed.append(spark.createDataFrame([row], PARAMETERS), f"{path}/parameters", replace=True)


def read_parameters(spark: SparkSession, path: str) -> RunParameters:
    """Scale arguments become floats again; index keys are integers."""
    rows = committed.read(spark, f"{path}/parameters", PARAMETERS)
    to_double = lambda _, args: F.transform_values(args, lambda _, v: v.cast("double"))
    row = rows.withColumn("scale_args", F.transform_values("scale_args", to_double)).first()
    known = committed.read(spark, f"{path}/indexes", INDEX)
    indexes = []
    for kind in ("ac", "rl"):
        table = known.where(F.col("kind") == kind).select("value", "idx")
        indexes.append(CategoryIndex(table, table.count() - 2))
    return RunParameters(
        dict(row["settings"]), row["one_timestamp"], row["max_trace_size"],
        {f: dict(args) for f, args in row["scale_args"].items()}, *indexes,
    )


def write_predictions(predictions: DataFrame, path: str) -> None:
    """The predictions of all runs, a folder for each; they replace earlier ones."""
    committed.append(predictions, path, replace=True, partition_by=("run_num",))


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return committed.read(spark, path, schema)


def write_scores(metrics: DataFrame, test_log: DataFrame, path: str) -> None:
    """The metric table and the log it was computed on."""
    metrics.write.mode("overwrite").csv(f"{path}/metrics", header=True)
    test_log.write.mode("overwrite").parquet(f"{path}/test_log")


EMBEDDING = "idx int, name string, vec array<float>"


def write_embedding(embedding: DataFrame, path: str) -> None:
    committed.append(embedding.select("idx", "name", "vec"), path, replace=True)


def read_embedding(spark: SparkSession, path: str, index: CategoryIndex) -> DataFrame:
    """Rows whose name is the one the index gives to their number."""
    stored = committed.read(spark, path, EMBEDDING)
    known = index.table.select("idx", F.col("value").alias("name"))
    return stored.withColumn("name", F.trim("name")).join(known, ["idx", "name"])


TRIALS = (
    "n_size int, norm_method string, loss double, sim_metric string, status string, "
    "scale_args string, output string"
)


def append_trials(trials: DataFrame, path: str) -> None:
    committed.append(trials.select(*[c.split()[0] for c in TRIALS.split(", ")]), path)


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Trial results; ``scale_args`` is parsed from its JSON text."""
    rows = committed.read(spark, path, TRIALS)
    return rows.withColumn("scale_args", F.from_json("scale_args", "map<string,map<string,double>>"))


def scale_args_json(args: dict) -> str:
    return json.dumps(args, sort_keys=True)
