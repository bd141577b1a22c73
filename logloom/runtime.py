"""Session-level helpers: pinned tables and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A dimension is broadcast only when its counted rows stay below this bound.
BROADCAST_ROWS = 500_000


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="logloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session.

    Only a local session, as in tests, may do without the setting.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        folder = _local_folder()
    return folder.rstrip("/")


def pin(df: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns the written table.

    Cuts the lineage of loops, survives the loss of executors, and gives the
    planner true sizes: a pinned table below the session's broadcast threshold
    is broadcast, a larger one is joined by shuffle.
    """
    return pin_at(df, f"{shared_folder(df.sparkSession)}/pinned/{uuid.uuid4().hex}")


def pin_at(df: DataFrame, path: str) -> DataFrame:
    """``pin`` into a new folder of the caller's choice."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with the hint that it is joined by shuffle, whatever its files weigh.

    For tables that grow with the input: dictionaries make the file of exploded or
    repeated strings far smaller than the rows that a broadcast puts into memory.
    """
    return df.hint("merge")


def dimension(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` allow it."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
