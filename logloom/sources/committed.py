"""Folders of appended tables of which readers see committed parts only.

Every append is a Parquet folder of its own; a small file in the manifest, written after
it, commits it. Parts whose writer was lost before that are never read, appends don't
touch each other's files, and a part that replaces others is seen instead of them from
its commit on.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "part string, replaces array<string>"


def append(df: DataFrame, path: str, replace: bool = False, partition_by: tuple[str, ...] = ()) -> None:
    """Adds ``df`` to the table; with ``replace`` it takes the place of all it holds now."""
    spark = df.sparkSession
    replaced = [p for p, _ in _entries(spark, path)] if replace else []
    part = uuid.uuid4().hex
    df.write.partitionBy(*partition_by).parquet(f"{path}/parts/{part}")
    commit = spark.createDataFrame([(part, replaced)], MANIFEST)
    commit.coalesce(1).write.mode("append").json(f"{path}/manifest")


def _entries(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """One (part, replaced parts) for each append."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return [(r["part"], r["replaces"] or []) for r in rows]


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of the committed parts; a table that was never written is empty."""
    entries = _entries(spark, path)
    gone = {p for _, replaced in entries for p in replaced}
    parts = [f"{path}/parts/{p}" for p, _ in entries if p not in gone]
    if not parts:
        return spark.createDataFrame([], schema)
    tables = [spark.read.schema(schema).parquet(p) for p in parts]
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out.select(*[F.col(c) for c in spark.createDataFrame([], schema).columns])
