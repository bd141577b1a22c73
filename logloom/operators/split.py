"""Temporal train/test splits that keep cases whole.

``contained``: the cutoff is the 0.8-quantile of the order key over events;
train takes cases that end by the cutoff, test those that start after it, and
cases across it are dropped. ``trace``: the first share of cases by start.
``auto``: contained, unless its test part is under a tenth of the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.times import micros
from logloom.operators.positions import null_safe_join
from logloom.operators.selection import flag_smallest, quantile_disc, share
from logloom.runtime import pin
from logloom.schema import LogSchema

TRAIN, TEST = "train", "test"
MIN_TEST_SHARE = 10  # the test part holds at least 1/10 of the events


def case_spans(log: DataFrame, schema: LogSchema) -> DataFrame:
    """Per case: events, first order key and last end, in microseconds."""
    return log.groupBy("caseid").agg(
        F.count(F.lit(1)).alias("events"),
        F.min(micros(schema.key)).alias("first_us"),
        F.max(micros("end_timestamp")).alias("last_us"),
    )


def contained_parts(log: DataFrame, spans: DataFrame, schema: LogSchema, size: float) -> DataFrame:
    """(caseid, events, part) of the cases that fit into one side."""
    cutoff = quantile_disc(log.select(micros(schema.key).alias("key_us")), "key_us", size)
    cutoff = F.lit(cutoff).cast("bigint")
    part = F.when(F.col("last_us") <= cutoff, TRAIN).when(F.col("first_us") > cutoff, TEST)
    spans = spans.withColumn("part", part)
    return spans.where(F.col("part").isNotNull()).select("caseid", "events", "part")


def trace_parts(spans: DataFrame, size: float) -> DataFrame:
    """(caseid, events, part) of all cases, by their start."""
    flagged = flag_smallest(spans, "first_us", ["caseid"], share(size), "_train")
    part = F.when(F.col("_train"), TRAIN).otherwise(TEST)
    return flagged.select("caseid", "events", part.alias("part"))


def case_parts(
    log: DataFrame, schema: LogSchema, size=0.8, method="auto", spans: DataFrame | None = None
) -> DataFrame:
    """``spans`` is the pinned ``case_spans`` of the log, if known."""
    if method not in ("contained", "trace", "auto"):
        raise ValueError(method)
    spans = pin(case_spans(log, schema)) if spans is None else spans
    if method == "trace":
        return trace_parts(spans, size)
    contained = contained_parts(log, spans, schema, size)
    if method == "contained":
        return contained
    in_test = F.when(F.col("part") == TEST, F.col("events"))
    test_events = contained.agg(F.coalesce(F.sum(in_test), F.lit(0))).first()[0]
    events = spans.agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0]
    if test_events < events // MIN_TEST_SHARE:
        return trace_parts(spans, size)
    return contained


def label_parts(
    log: DataFrame, schema: LogSchema, size=0.8, method="auto", spans: DataFrame | None = None
) -> DataFrame:
    """Adds ``part``; events of dropped cases are left out.

    The case table has one row per case and no hot key; a hot case is a hot key
    of the event side only, which the adaptive skew join splits.
    """
    parts = case_parts(log, schema, size, method, spans).drop("events")
    return null_safe_join(log, parts, ["caseid"])


def split_timeline(
    log: DataFrame, schema: LogSchema, size: float = 0.8, method: str = "auto"
) -> tuple[DataFrame, DataFrame]:
    """(train, test)."""
    labelled = label_parts(log, schema, size, method)
    train = labelled.where(F.col("part") == TRAIN).drop("part")
    test = labelled.where(F.col("part") == TEST).drop("part")
    return train, test
