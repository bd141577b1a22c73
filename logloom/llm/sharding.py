"""Contiguous shards of nearly equal bytes, cut by global prefix sums.

Only the key, the size and a checksum of each document travel. They are sorted into
range partitions and written; each partition's total, one row, gives the sum before
it, and a window within the partition gives the sum before each row. The line of all
bytes is then cut at equal targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.runtime import pin

# Rows of a sorted partition are numbered from 0 in the low bits.
ROW_BITS = 33
# What a document costs besides its text.
OVERHEAD = 16


def sizes(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32); a null text has no bytes, as an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )


def by_bytes(sized: DataFrame, shards: int) -> DataFrame:
    """Adds ``law``, ``shard``, ``slot`` and ``grown_shard`` to (doc_id, size, ...).

    Documents are in ascending doc_id, null first; rows with equal keys are told
    apart by where they were read, so they all keep a slot. A document belongs to the
    shard in whose share of the bytes its middle lies, so a shard is off its share by
    at most half a document at either end. ``grown_shard`` is null: with one more
    shard all cuts move. No documents give no rows.
    """
    rows = pin(sized.withColumn("_tie", F.monotonically_increasing_id()))
    order = [F.asc_nulls_first("doc_id"), F.asc("_tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = pin(rows.withColumn("_id", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_id", ROW_BITS))

    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    totals = rows.groupBy("_part").agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
    totals = totals.select(  # one row for each partition
        "_part",
        F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(every).alias("_total"),
    )
    within = W.partitionBy("_part").orderBy("_id").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        rows.withColumn("_local", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(F.broadcast(totals), "_part")
        .withColumn("_place", F.col("_rows_before") + F.col("_id").bitwiseAND((1 << ROW_BITS) - 1))
        .withColumn(
            "shard",
            F.expr(
                f"cast((2 * (_bytes_before + _local) + size) * {int(shards)} div (2 * _total) as int)"
            ),
        )
    )
    first = placed.groupBy("shard").agg(F.min("_place").alias("_first"))  # a row for each shard
    return (
        placed.join(F.broadcast(first), "shard")
        .withColumn("slot", F.col("_place") - F.col("_first"))
        .withColumn("law", F.lit("bytes"))
        .withColumn("grown_shard", F.lit(None).cast("int"))
        .select(*sized.columns, "law", "shard", "slot", "grown_shard")
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, key: str = "doc_id") -> None:
    """Writes the documents as one folder for each shard, ``shard=0`` and so on.

    ``key`` must be unique. Rows are dealt by (shard, slot), so a shard is written by
    several tasks and no shard goes through one.
    """
    places = assigned.select(F.col("doc_id").alias("_key"), "shard", "slot")
    rows = docs.join(places, docs[key].eqNullSafe(places["_key"])).drop("_key")
    rows = rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.drop("slot").write.partitionBy("shard").parquet(path)
