"""Event logs over the warehouse tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.times import add_micros


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _interaction_events(spark, folder, case) -> DataFrame:
    duration = F.round(F.col("value") * 1000).cast("bigint") * 1000
    return _table(spark, folder, "events").select(
        case.alias("caseid"),
        F.col("event_type").alias("task"),
        F.get_json_object("props", "$.k").alias("user"),
        F.col("ts").alias("start_timestamp"),
        add_micros("ts", duration).alias("end_timestamp"),
        F.col("event_id").alias("event_key"),
    )


def user_log(spark: SparkSession, folder: str) -> DataFrame:
    """Long cases: one per user."""
    return _interaction_events(spark, folder, F.col("user_id").cast("string"))


def user_day_log(spark: SparkSession, folder: str) -> DataFrame:
    """Short cases: one per user and day."""
    day = F.date_format("ts", "yyyy-MM-dd")
    case = F.concat_ws("-", F.col("user_id").cast("string"), day)
    return _interaction_events(spark, folder, case)


def shipment_log(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as activities: the part type, handled by the supplier."""
    part = _table(spark, folder, "part").select("p_partkey", "p_type")
    hours = F.col("l_quantity").cast("bigint") * 3_600_000_000
    return (
        _table(spark, folder, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").cast("string").alias("caseid"),
            F.col("p_type").alias("task"),
            F.col("l_suppkey").cast("string").alias("user"),
            F.col("l_shipdate").alias("start_timestamp"),
            add_micros("l_shipdate", hours).alias("end_timestamp"),
            F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("event_key"),
        )
    )


def order_log(spark: SparkSession, folder: str) -> DataFrame:
    """Point events: the orders of a customer."""
    return _table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("caseid"),
        F.col("o_orderstatus").alias("task"),
        F.col("o_orderpriority").alias("user"),
        F.col("o_orderdate").alias("end_timestamp"),
        F.col("o_orderkey").alias("event_key"),
    )


def dialogue_log(spark: SparkSession, folder: str) -> DataFrame:
    """Control flow only: the turns of a conversation."""
    return _table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("caseid"),
        F.col("role").alias("task"),
        F.col("role").alias("user"),
        F.col("turn").alias("event_key"),
    )
