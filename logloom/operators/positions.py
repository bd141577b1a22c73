"""Numbering rows and looking at neighbours when one group may be huge.

A window over a case puts the whole case into one task. That is the right plan
for ordinary cases, and a stalled job when one case holds a third of the log.
The functions here count the groups first (combined before the shuffle) and give the
large ones another plan: rows are range-partitioned by
(group, order), numbered slice by slice, and windows run over segments of fixed
length that carry copies of the few neighbours they need.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.runtime import pin
from logloom.schema import LogSchema

# Rows above which a group no longer goes through one task.
HOT_ROWS = 1_000_000
# Rows of a segment of such a group.
SEGMENT_ROWS = 250_000


def hot_groups(df: DataFrame, by: list[str]) -> list[int]:
    """Hashes of all groups with more than HOT_ROWS rows.

    Counts are exact and combined before the shuffle. What the driver reads is one
    number for each such group, so at most one for every HOT_ROWS rows.
    """
    counts = df.groupBy(F.xxhash64(*by).alias("h")).agg(F.count(F.lit(1)).alias("n"))
    return [r["h"] for r in counts.where(F.col("n") > HOT_ROWS).select("h").collect()]


def hot_counted(counts: DataFrame, by: list[str], rows: str) -> list[int]:
    """``hot_groups`` from a table of group sizes."""
    over = counts.where(F.col(rows) > HOT_ROWS)
    return [r["h"] for r in over.select(F.xxhash64(*by).alias("h")).collect()]


def null_safe_join(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner"):
    """Join on ``by`` that takes NULL as a value like others; ``left``'s columns stay."""
    right = right.withColumnsRenamed({c: f"_by_{c}" for c in by})
    on = F.lit(True)
    for c in by:
        on = on & left[c].eqNullSafe(right[f"_by_{c}"])
    return left.join(right, on, how).drop(*[f"_by_{c}" for c in by])


def _is_hot(by: list[str], hashes: list[int]) -> Column:
    return F.xxhash64(*by).isin(hashes)


def _slices(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """Rows in range partitions of (by, order), numbered by ``_slice`` and ``_id``.

    Rows with equal keys share a slice, so the keys should be (nearly) unique.
    """
    sorted_rows = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    rows = pin(sorted_rows.withColumn("_id", F.monotonically_increasing_id()))
    return rows.withColumn("_slice", F.shiftright("_id", 33))


def sliced_totals(df: DataFrame, by: list[str], order: list, weight: str, out: str) -> DataFrame:
    """Running sum of ``weight`` within ``by``, current row included, by slices.

    What is carried into a slice is a written table with a row for each slice and group;
    the planner knows its size and joins it accordingly, however many groups there are.
    """
    rows = _slices(df, by, order)
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy(*by, "_slice").agg(F.sum(weight).alias("_sum"))
    carried = pin(carried.select(
        *by, "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry")
    ))
    upto = W.partitionBy(*by, "_slice").orderBy("_id").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum(weight).over(upto))
    rows = null_safe_join(rows, carried, [*by, "_slice"])
    return rows.select(*df.columns, (F.col("_local") + F.col("_carry")).alias(out))


def sliced_rank(df: DataFrame, by: list[str], order: list, out: str) -> DataFrame:
    """row_number within ``by`` without putting a group into one task.

    Range partitions are numbered locally; the rows before each slice come from
    a table with one row per (slice, group), so use it for few groups only.
    """
    rows = _slices(df, by, order)
    slices = rows.groupBy(*by, "_slice").agg(
        F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    earlier = W.partitionBy(*by).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = slices.select(
        "_slice",
        *[F.col(c).alias(f"_by_{c}") for c in by],
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = [rows["_slice"] == slices["_slice"]]
    same += [rows[c].eqNullSafe(slices[f"_by_{c}"]) for c in by]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    joined = rows.join(F.broadcast(slices), on).select(
        *[rows[c] for c in df.columns], (F.col("_id") + F.col("_shift")).alias(out)
    )
    return joined


def global_rank(df: DataFrame, order: list, out: str, rows: int) -> DataFrame:
    """1-based rank over the whole table; ``rows`` is its counted size."""
    if rows <= HOT_ROWS:
        return df.withColumn(out, F.row_number().over(W.orderBy(*order)).cast("bigint"))
    return sliced_rank(df, [], order, out)


def grouped_running_total(
    df: DataFrame, by: str, order: list[str], value: str, out: str, hot: list[int] | None = None
) -> DataFrame:
    """Sum of ``value`` over the rows before the current one in its group, in ``order``.

    ``hot`` is the known answer of ``hot_groups(df, [by])``, if any.
    """
    hot = hot_groups(df, [by]) if hot is None else hot
    before = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    total = F.coalesce(F.sum(value).over(before), F.lit(0))
    if not hot:
        return df.withColumn(out, total)
    plain = df.where(~_is_hot([by], hot)).withColumn(out, total)
    split = sliced_totals(df.where(_is_hot([by], hot)), [by], order, value, out)
    return plain.unionByName(split.withColumn(out, F.col(out) - F.col(value)))


def grouped_medians(
    df: DataFrame, by: list[str], values: list[str], hot: list[int] | None = None, size: str | None = None
) -> DataFrame:
    """Lower median of each value column per group, exactly; ``size`` names its count, if asked for.

    Ordinary groups take one exchange and a sort per column. The values of hot
    groups are counted first, in one pass a column, so ties cost nothing, and the written
    counts are summed slice by slice.
    """
    hot = hot_groups(df, by) if hot is None else hot
    # the hash comes first, so that sorts compare numbers and not the columns of the group
    group = ["_group", *by]
    middle = F.ceil(F.count(F.lit(1)).over(W.partitionBy(*group)) / 2)
    ranks = {f"_{v}": F.row_number().over(W.partitionBy(*group).orderBy(v)) for v in values}
    picked = [F.max(F.when(F.col(f"_{v}") == F.col("_middle"), F.col(v))).alias(v) for v in values]
    sized = [F.count(F.lit(1)).alias(size)] if size else []
    plain = df.withColumn("_group", F.xxhash64(*by))
    plain = plain.where(~F.col("_group").isin(hot)) if hot else plain
    plain = plain.withColumns({"_middle": middle, **ranks}).groupBy(*group).agg(*picked, *sized).drop("_group")
    if not hot:
        return plain
    rows = df.where(_is_hot(by, hot))
    counted = {v: pin(rows.groupBy(*by, v).agg(F.count(F.lit(1)).alias("_n"))) for v in values}
    sized = [F.sum("_n").alias(size)] if size else []
    found = counted[values[0]].groupBy(*by).agg(F.ceil(F.sum("_n") / 2).alias("_middle"), *sized)
    sizes = F.broadcast(found.select(*by, "_middle"))  # a row for each hot group
    for v in values:
        summed = null_safe_join(sliced_totals(counted[v], by, [v], "_n", "_upto"), sizes, by)
        at_middle = summed.where("_upto >= _middle and _upto - _n < _middle")
        found = null_safe_join(found, at_middle.select(*by, v), by)
    return plain.unionByName(found.drop("_middle"))


# Parts of a value's logarithm that ``hot_medians`` tells apart at first.
FINE = 4096


def hot_medians(df: DataFrame, by: list[str], values: list[str], parts: list[Column]) -> DataFrame:
    """Lower medians of large groups in several parts of the rows, exactly.

    Returns ``by``, and for part k its rows ``n_<k>`` and the median ``<value>_<k>`` of each
    value; ``parts`` are 0 or 1. Values are counted by their rounded logarithm first, and one
    by one only where a median lies, so few of them are sorted. NULL is the smallest value.
    """
    numbers = range(len(parts))
    log = lambda v: F.floor(F.signum(v) * F.log1p(F.abs(F.col(v))) * FINE)
    least = F.lit(-(1 << 63)).cast("bigint")
    cells = [
        F.struct(F.lit(v).alias("_of"), F.coalesce(log(v), least).alias("_near"), F.col(v).cast("double").alias("_value"))
        for v in values
    ]
    rows = df.select(*by, *[p.alias(f"n_{k}") for k, p in enumerate(parts)], F.explode(F.array(*cells)).alias("_c"))
    rows = rows.select(*by, *[f"n_{k}" for k in numbers], "_c.*")
    near = pin(rows.groupBy(*by, "_of", "_near").agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in numbers]))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("_part"), F.col(f"n_{k}").alias("_n")) for k in numbers]))
    group = [*by, "_of", "_part"]
    near = near.select(*by, "_of", "_near", each.alias("_c")).select(*by, "_of", "_near", "_c.*").where("_n > 0")
    near = pin(near)
    sizes = near.groupBy(*group).agg(F.sum("_n").alias("_size"))  # a row for each part of a large group
    upto = null_safe_join(sliced_totals(near, group, ["_near"], "_n", "_upto"), F.broadcast(sizes), group)
    upto = upto.withColumn("_middle", F.ceil(F.col("_size") / 2)).where("_upto >= _middle and _upto - _n < _middle")
    picked = pin(upto.select(*group, "_near", "_size", (F.col("_middle") - F.col("_upto") + F.col("_n")).alias("_rank")))
    place = F.xxhash64(*by, "_of", "_near").alias("h")
    places = [r["h"] for r in picked.select(place).distinct().collect()]  # one or two for each of them
    near_values = null_safe_join(rows.where(place.isin(places)), F.broadcast(picked), [*by, "_of", "_near"])
    held = F.element_at(F.array(*[F.col(f"n_{k}") for k in numbers]), F.col("_part") + 1)
    counted = near_values.where(held > 0).groupBy(*group, "_size", "_rank", "_value").agg(F.count(F.lit(1)).alias("_n"))
    upto = sliced_totals(pin(counted), group, ["_value"], "_n", "_upto")
    found = upto.where("_upto >= _rank and _upto - _n < _rank")
    wide = []
    for k in numbers:
        own = F.col("_part") == k
        wide.append(F.coalesce(F.max(F.when(own, F.col("_size"))), F.lit(0)).alias(f"n_{k}"))
        wide += [F.max(F.when(own & (F.col("_of") == v), F.col("_value"))).alias(f"{v}_{k}") for v in values]
    return found.groupBy(*by).agg(*wide)


def number_rows(
    df: DataFrame, by: list[str], order: list[str], out: str = "pos", hot: list[int] | None = None
) -> DataFrame:
    """1-based position of each row within its group.

    ``hot`` is the known answer of ``hot_groups(df, by)``, if any.
    """

    def plain(rows):
        number = F.row_number().over(W.partitionBy(*by).orderBy(*order))
        return rows.withColumn(out, number.cast("bigint"))

    hot = hot_groups(df, by) if hot is None else hot
    if not hot:
        return plain(df)
    split = sliced_rank(df.where(_is_hot(by, hot)), by, order, out)
    return plain(df.where(~_is_hot(by, hot))).unionByName(split)


def placed_in_cases(df: DataFrame, order: list[str], pos: str, size: str) -> DataFrame:
    """Each event's 1-based position in its case and the case's number of events."""

    def plain(rows):
        w = W.partitionBy("caseid")
        number = F.row_number().over(w.orderBy(*order)).cast("bigint")
        return rows.withColumns({pos: number, size: F.count(F.lit(1)).over(w)})

    hot = hot_groups(df, ["caseid"])
    if not hot:
        return plain(df)
    split = sliced_rank(df.where(_is_hot(["caseid"], hot)), ["caseid"], order, pos)
    sizes = split.groupBy("caseid").agg(F.max(pos).alias(size))  # a row for each hot case
    split = null_safe_join(split, F.broadcast(sizes), ["caseid"])
    return plain(df.where(~_is_hot(["caseid"], hot))).unionByName(split)


@dataclass(frozen=True)
class Frame:
    """What a trace-ordered expression may refer to."""

    rows: WindowSpec
    pos: Column
    case_start: Column

    def span(self, low: int, high: int) -> WindowSpec:
        return self.rows.rowsBetween(low, high)

    @property
    def is_last(self) -> Column:
        """Needs ``ahead >= 1``."""
        return F.lead(F.lit(1)).over(self.rows).isNull()


def over_traces(
    log: DataFrame,
    schema: LogSchema,
    build: Callable[[Frame], dict[str, Column]],
    back: int = 0,
    ahead: int = 0,
    hot: list[int] | None = None,
) -> DataFrame:
    """Adds trace-ordered columns that look at most ``back`` rows behind and
    ``ahead`` rows ahead of the current event.

    ``hot`` is the known answer of ``hot_groups`` for the cases, if any.
    """
    case, key = "caseid", schema.key

    def plain(rows):
        w = W.partitionBy(case).orderBy(*schema.order)
        frame = Frame(w, F.row_number().over(w).cast("bigint"), F.first(key).over(w))
        return rows.withColumns(build(frame))

    hot = hot_groups(log, [case]) if hot is None else hot
    if not hot:
        return plain(log)
    placed = sliced_rank(log.where(_is_hot([case], hot)), [case], schema.order, "_pos")
    starts = placed.groupBy(case).agg(F.min(key).alias("_start"))  # a row for each hot case
    size = max(SEGMENT_ROWS, back, ahead)
    home = F.floor((F.col("_pos") - 1) / size)
    offset = (F.col("_pos") - 1) % size
    none = F.array().cast("array<bigint>")
    segments = F.concat(
        F.array(home),
        F.when(offset >= size - back, F.array(home + 1)).otherwise(none),
        F.when((offset < ahead) & (home > 0), F.array(home - 1)).otherwise(none),
    )
    segmented = (
        null_safe_join(placed, F.broadcast(starts), [case])
        .withColumn("_home", home)
        .withColumn("_segment", F.explode(segments))
    )
    w = W.partitionBy(case, "_segment").orderBy("_pos")
    built = segmented.withColumns(build(Frame(w, F.col("_pos"), F.col("_start"))))
    built = built.where(F.col("_segment") == F.col("_home"))
    built = built.drop("_pos", "_start", "_home", "_segment")
    return plain(log.where(~_is_hot([case], hot))).unionByName(built)
