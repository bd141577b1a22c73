"""Dictionary encoding of activities and roles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.positions import global_rank
from logloom.runtime import dimension, pin
from logloom.schema import END_LABEL, NO_ROLE, START_LABEL


@dataclass(frozen=True)
class CategoryIndex:
    """``table(value, idx)``: ``start`` is 0, values 1..n sorted, ``end`` n+1."""

    table: DataFrame
    values: int

    @property
    def end(self) -> int:
        return self.values + 1

    @property
    def size(self) -> int:
        return self.values + 2


def build_indexes(
    log: DataFrame, columns: list[str], null_label: str = NO_ROLE
) -> list[CategoryIndex]:
    """One index per column, from one pass over the log."""
    cells = [
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c), F.lit(null_label)).alias("value"))
        for c in columns
    ]
    values = log.select(F.explode(F.array(*cells)).alias("c")).select("c.*").distinct()
    values = pin(values)
    sizes = dict(values.groupBy("column").count().collect())
    return [
        _index(values.where(F.col("column") == c).select("value"), sizes.get(c, 0)) for c in columns
    ]


def _index(values: DataFrame, n: int) -> CategoryIndex:
    ranked = global_rank(values, ["value"], "idx", n).select("value", F.col("idx").cast("int"))
    ends = F.array(
        F.struct(F.lit(START_LABEL).alias("value"), F.lit(0).alias("idx")),
        F.struct(F.lit(END_LABEL).alias("value"), F.lit(n + 1).alias("idx")),
    )
    sentinels = values.sparkSession.range(1).select(F.inline(ends))
    return CategoryIndex(ranked.unionByName(sentinels), n)


def build_index(log: DataFrame, column: str, null_label: str = NO_ROLE) -> CategoryIndex:
    return build_indexes(log, [column], null_label)[0]


def encode(log, index: CategoryIndex, column: str, out: str, null_label: str = NO_ROLE):
    """Adds the index of ``column`` as ``out``."""
    lookup = index.table.where(F.col("idx").between(1, index.values)).select(
        F.col("value").alias("_value"), F.col("idx").alias(out)
    )
    same = F.coalesce(F.col(column), F.lit(null_label)) == F.col("_value")
    return log.join(dimension(lookup, index.size), same, "left").drop("_value")


def decode(rows, index: CategoryIndex, column: str, out: str):
    """Adds the label of an index column as ``out``."""
    lookup = index.table.select(F.col("idx").alias("_idx"), F.col("value").alias(out))
    same = F.col(column) == F.col("_idx")
    return rows.join(dimension(lookup, index.size), same, "left").drop("_idx")


def encode_log(log) -> tuple[DataFrame, CategoryIndex, CategoryIndex]:
    """Adds ``ac_index`` and ``rl_index``; returns both indexes too."""
    activities, roles = build_indexes(log, ["task", "role"])
    log = encode(log, activities, "task", "ac_index")
    return encode(log, roles, "role", "rl_index"), activities, roles


def max_trace_size(log: DataFrame) -> DataFrame:
    """Events of the longest case."""
    sizes = log.groupBy("caseid").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max("n").alias("max_trace_size"))


def log_extent(log: DataFrame, key: str = "start_timestamp") -> DataFrame:
    """Number of cases and first timestamp. Cases are counted exactly."""
    cases = log.groupBy("caseid").agg(F.min(key).alias("_first"))
    return cases.agg(F.count(F.lit(1)).alias("num_cases"), F.min("_first").alias("start_time"))
