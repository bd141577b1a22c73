"""(activity, role) pairs: observed, unobserved and sampled."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.draws import draw_key, uniform
from logloom.functions.times import micros
from logloom.operators.positions import global_rank
from logloom.operators.selection import sample_rows
from logloom.runtime import pin
from logloom.schema import LogSchema

# Ranks of unobserved pairs that one row is expanded to.
PIECE = 4096
# Ranks of a stretch in which draws meet runs of unobserved pairs.
STRETCH = 64


def observed_pairs(log: DataFrame) -> DataFrame:
    return log.groupBy("ac_index", "rl_index").agg(F.count(F.lit(1)).alias("n"))


def gaps(log: DataFrame, n_activities: int, n_roles: int) -> tuple[DataFrame, int]:
    """(low, high, shift): the runs of index pairs that the log does not hold; their number.

    All pairs, sentinels included, are laid on a line by (activity, role). Unobserved ones
    are ranked from 0; those ranked low..high - 1 lie ``shift`` places after their rank.
    One row for each observed pair at most, whatever the size of the grid.
    """
    place = (F.col("ac_index").cast("bigint") * n_roles + F.col("rl_index")).alias("_place")
    inside = F.col("ac_index").between(0, n_activities - 1) & F.col("rl_index").between(0, n_roles - 1)
    taken = pin(log.where(inside).select(place).distinct())
    n = taken.count()
    size = n_activities * n_roles - n
    ranked = pin(global_rank(taken, ["_place"], "_i", n).select("_i", (F.col("_place") - F.col("_i") + 1).alias("high")))
    before = ranked.select((F.col("_i") + 1).alias("_i"), F.col("high").alias("low"))
    found = ranked.join(before, "_i", "left").select(
        F.coalesce("low", F.lit(0)).alias("low"), "high", (F.col("_i") - 1).alias("shift")
    )
    last = log.sparkSession.range(1).select(F.lit(n).cast("bigint").alias("_i"))
    last = last.join(ranked, "_i", "left").select(
        F.coalesce("high", F.lit(0)).alias("low"), F.lit(size).cast("bigint").alias("high"), F.col("_i").alias("shift")
    )
    return found.unionByName(last).where("low < high"), size


def _pieces(runs: DataFrame, width: int) -> DataFrame:
    """The runs cut at the multiples of ``width``, with the number of their stretch."""
    cut = F.explode(F.sequence(F.expr(f"low div {width}"), F.expr(f"(high - 1) div {width}")))
    pieces = runs.withColumn("stretch", cut)
    return pieces.withColumns(
        {
            "low": F.greatest("low", F.col("stretch") * width),
            "high": F.least("high", (F.col("stretch") + 1) * width),
        }
    )


def _pair(place: Column, n_roles: int) -> list[Column]:
    role = (place % n_roles).cast("int")
    return [F.floor((place - place % n_roles) / n_roles).cast("int").alias("ac_index"), role.alias("rl_index")]


def unobserved_pairs(log: DataFrame, n_activities: int, n_roles: int) -> DataFrame:
    """Index pairs, sentinels included, that the log does not hold."""
    runs, _ = gaps(log, n_activities, n_roles)
    rank = F.explode(F.sequence("low", F.col("high") - 1))
    places = _pieces(runs, PIECE).select((rank.alias("_rank")), "shift")
    return places.select(*_pair(F.col("_rank") + F.col("shift"), n_roles))


def negative_samples(
    log: DataFrame,
    n_activities: int,
    n_roles: int,
    seed: int,
    ratio: int = 2,
    positive_label: int = 1,
    n_positive: int | None = None,
    schema: LogSchema = LogSchema(),
) -> DataFrame:
    """(ac_index, rl_index, label, shuffle_key).

    ``n_positive`` events without replacement (default: a third of the log),
    and ``ratio`` times as many unobserved pairs with replacement. A log that
    holds every pair has no negatives.
    """
    tiebreak = [F.col(c).cast("string") for c in schema.tiebreak]
    identity = [F.col("caseid"), micros(schema.key), *tiebreak]
    events = log.select(
        "ac_index", "rl_index", "caseid", *schema.order,
        draw_key(*identity, str(seed)).alias("_draw"),
    )
    events = pin(events)
    pick = (lambda rows: n_positive) if n_positive else (lambda rows: round(rows / 3))
    taken = sample_rows(events, "_draw", ["caseid", *schema.order], pick)
    positives = taken.select(
        "ac_index", "rl_index", F.lit(positive_label).alias("label"), F.col("_draw").alias("_key")
    )
    count = n_positive or round(events.count() / 3)
    runs, size = gaps(events, n_activities, n_roles)
    if size == 0:
        return _shuffled(positives, seed)
    # a stretch of ranks has at most so many runs, and about one draw if there are few
    width = max(STRETCH, -(-size // max(count * ratio, 1)))
    draws = log.sparkSession.range(count * ratio).withColumn(
        "_rank", F.floor(uniform(F.lit("negative"), F.col("id"), str(seed)) * size)
    )
    draws = draws.withColumn("stretch", F.expr(f"_rank div {width}"))
    met = draws.join(_pieces(runs, width), "stretch").where("_rank >= low and _rank < high")
    negatives = met.select(
        *_pair(F.col("_rank") + F.col("shift"), n_roles),
        F.lit(1 - positive_label).alias("label"),
        F.col("id").alias("_key"),
    )
    return _shuffled(positives.unionByName(negatives), seed)


def _shuffled(rows: DataFrame, seed: int) -> DataFrame:
    """Sorting by ``shuffle_key`` gives the random order of a batch."""
    key = draw_key(F.col("label"), F.col("_key"), str(seed))
    return rows.select("ac_index", "rl_index", "label", key.alias("shuffle_key"))


def embedding_dimension(n_activities: int, n_roles: int) -> int:
    return math.ceil((n_activities * n_roles) ** 0.25)
