"""Scores of predictions and of generated logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.arrays import total
from logloom.functions.distance import similarity, timed_similarity
from logloom.functions.times import micros, weekday
from logloom.operators.features import add_calculated_times
from logloom.operators.positions import (
    HOT_ROWS, global_rank, grouped_running_total, null_safe_join, number_rows,
)
from logloom.runtime import pin
from logloom.schema import LogSchema, drop_sentinels, prefix_cases

# Entries of the run parameters that do not describe the experiment (fixed values).
BOOKKEEPING = (
    "activity", "read_options", "column_names", "one_timestamp", "reorder", "index_ac",
    "index_rl", "dim", "max_dur", "variants", "is_single_exec",
)
# Mass of one slice of a coupling; bounds the rows one window sees.
SLICE_MASS = 100_000


def _features(records: DataFrame) -> list[str]:
    return ["tm"] if "tm_pred" in records.columns else ["dur", "wait"]


def _long(wide: DataFrame, names: list[str], by: list[str], value: str) -> DataFrame:
    """One row per feature from one column per feature."""
    entries = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias(value)) for n in names])
    return wide.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")


def accuracy(records: DataFrame) -> DataFrame:
    """(feature, accuracy) of the next activity and role."""
    hit = {f: F.avg((F.col(f"{f}_pred") == F.col(f"{f}_expect")).cast("int")) for f in ("ac", "rl")}
    return _long(records.agg(*[c.alias(f) for f, c in hit.items()]), list(hit), [], "accuracy")


def mae_next(records: DataFrame) -> DataFrame:
    """(feature, mae) of the next times, in seconds."""
    names = _features(records)
    errors = [F.avg(F.abs(F.col(f"{f}_expect") - F.col(f"{f}_pred"))).alias(f) for f in names]
    return _long(records.agg(*errors), names, [], "mae")


def suffix_similarity(records: DataFrame) -> DataFrame:
    """(feature, pref_size, mean) similarity of predicted and expected suffixes.

    Equal pairs are counted first, so the kernel sees each pair once per size.
    """
    sides = [
        records.select(
            F.lit(f).alias("feature"), "pref_size",
            F.col(f"{f}_pred").alias("pred"), F.col(f"{f}_expect").alias("expect"),
        )
        for f in ("ac", "rl")
    ]
    pairs = reduce(DataFrame.unionByName, sides).groupBy("feature", "pref_size", "pred", "expect")
    scored = pairs.count().withColumn("sim", similarity("pred", "expect"))
    mean = F.sum(F.col("sim") * F.col("count")) / F.sum("count")
    return scored.groupBy("feature", "pref_size").agg(mean.alias("mean"))


def mae_suffix(records: DataFrame) -> DataFrame:
    """(feature, pref_size, mean) error of the summed suffix times."""
    names = _features(records)
    errors = [
        F.avg(F.abs(total(F.col(f"{f}_expect")) - total(F.col(f"{f}_pred")))).alias(f)
        for f in names
    ]
    return _long(records.groupBy("pref_size").agg(*errors), names, ["pref_size"], "mean")


def mean_metric(scores: DataFrame, column: str) -> DataFrame:
    return scores.agg(F.avg(column).alias("mean"))


def experiment_descriptor(params: dict) -> dict:
    return {k: v for k, v in params.items() if k not in BOOKKEEPING}


def describe(scores: DataFrame, params: dict) -> DataFrame:
    """Attaches the experiment's parameters to every score."""
    return scores.withColumns({k: F.lit(v) for k, v in experiment_descriptor(params).items()})


def cycle_times(log: DataFrame, schema: LogSchema = LogSchema(), by: tuple = ()) -> DataFrame:
    """(caseid, cycle_us): last end minus first order key of each case."""
    span = F.max(micros("end_timestamp")) - F.min(micros(schema.key))
    return log.groupBy(*by, "caseid").agg(span.alias("cycle_us"))


# The metrics below compare one log with all runs of generated logs in one plan. ``runs``
# has ``run_num`` and case ids that are unique over all runs; ``numbers`` are the runs'.
RUN = "run_num"


def _for_each(df: DataFrame, numbers: list[int]) -> DataFrame:
    """A small table of the log, once for each run."""
    return df.withColumn(RUN, F.explode(F.array(*[F.lit(n) for n in numbers])))


def _log_mae(log: DataFrame, runs: DataFrame, numbers: list[int], schema: LogSchema) -> DataFrame:
    own = _for_each(cycle_times(log, schema).agg(F.avg("cycle_us").alias("own")), numbers)
    means = cycle_times(runs, schema, (RUN,)).groupBy(RUN).agg(F.avg("cycle_us").alias("m"))
    return means.join(own, RUN).select(RUN, (F.abs(F.col("own") - F.col("m")) / 1e6).alias("sim_val"))


def couple(
    left: DataFrame, right: DataFrame, order: list[str], out: list[str], by: str | None = None
) -> DataFrame:
    """Matches two weighted lists in order, for each value of ``by``: (by, l, r, mass).

    Both sides hold distinct rows with a weight ``n``. Laid end to end in
    ``order`` they cut the same line; each stretch of it is one pair, so the
    pairs are at most as many as the rows. The line is cut into slices of
    bounded mass, and within a slice the current row of either side is the last
    one seen.
    """
    if by is None:
        sides = [x.withColumn("_by", F.lit(0)) for x in (left, right)]
        return couple(*sides, order, out, "_by").drop("_by")
    sides = [pin(side) for side in (left, right)]
    sums = [x.groupBy(by).agg(F.count(F.lit(1)), F.sum("n")).collect() for x in sides]  # a row for each run
    rows, mass = ([{r[0]: r[k] for r in each} for each in sums] for k in (1, 2))
    hot = [] if all(n <= HOT_ROWS for each in rows for n in each.values()) else None
    known = [(run, min(mass[0][run], mass[1][run])) for run in mass[0].keys() & mass[1].keys()]
    kind = left.schema[by].dataType.simpleString()
    lines = F.broadcast(left.sparkSession.createDataFrame(known, f"{by} {kind}, _line bigint"))
    starts = []
    for side, name in zip(sides, ("l", "r")):
        side = grouped_running_total(side, by, order, "n", "_low", hot).join(lines, by)
        high = F.least(F.col("_low") + F.col("n"), F.col("_line")) - 1
        slices = F.sequence(F.expr(f"_low div {SLICE_MASS}"), F.floor(high / SLICE_MASS))
        pieces = side.where("_low < _line").withColumn("slice", F.explode(slices))
        at = F.greatest(F.col("_low"), F.col("slice") * SLICE_MASS)
        starts.append(pieces.select(by, "slice", "_line", at.alias("at"), F.struct(*out).alias(name)))
    merged = starts[0].unionByName(starts[1], allowMissingColumns=True)
    merged = merged.groupBy(by, "slice", "at").agg(
        F.first("_line").alias("_line"),
        F.first("l", ignorenulls=True).alias("l"),
        F.first("r", ignorenulls=True).alias("r"),
    )
    w = W.partitionBy(by, "slice").orderBy("at")
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    end = F.least((F.col("slice") + 1) * SLICE_MASS, F.col("_line"))
    return merged.select(
        by,
        F.last("l", ignorenulls=True).over(upto).alias("l"),
        F.last("r", ignorenulls=True).over(upto).alias("r"),
        (F.coalesce(F.lead("at").over(w), end) - F.col("at")).alias("mass"),
    )


def _cycle_mae(log: DataFrame, runs: DataFrame, numbers: list[int], schema: LogSchema) -> DataFrame:
    count = F.count(F.lit(1)).alias("n")
    own = _for_each(cycle_times(log, schema).groupBy("cycle_us").agg(count), numbers)
    theirs = cycle_times(runs, schema, (RUN,)).groupBy(RUN, "cycle_us").agg(count)
    pairs = couple(own, theirs, ["cycle_us"], ["cycle_us"], RUN)
    error = F.sum(F.abs(F.col("l.cycle_us") - F.col("r.cycle_us")) * F.col("mass"))
    return pairs.groupBy(RUN).agg((error / F.sum("mass") / 1e6).alias("sim_val"))


def _traces(log: DataFrame, schema: LogSchema, fields: list[str], by: tuple = ()) -> DataFrame:
    """(caseid, tasks, ...) arrays per case in event order."""
    events = F.sort_array(F.collect_list(F.struct(*schema.order, "task", *fields))).alias("e")
    return log.groupBy(*by, "caseid").agg(events).select(
        *by, "caseid", F.col("e.task").alias("tasks"), *[F.col(f"e.{f}").alias(f) for f in fields]
    )


def _control_flow(log: DataFrame, runs: DataFrame, numbers: list[int], schema: LogSchema) -> DataFrame:
    count = F.count(F.lit(1))
    own = _traces(log, schema, []).groupBy("tasks").agg(count.alias("nl"))
    own = _for_each(own, numbers)
    theirs = _traces(runs, schema, [], (RUN,)).groupBy(RUN, "tasks").agg(count.alias("nr"))
    both = own.join(theirs, [RUN, "tasks"], "full")
    both = pin(both.select(RUN, "tasks", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("nl", "nr")]))
    totals = both.groupBy(RUN).agg(
        F.sum(F.least("nl", "nr")).alias("same"), F.greatest(F.sum("nl"), F.sum("nr")).alias("cases")
    )
    rest = both.withColumns({"size": F.size("tasks"), "key": F.array_join("tasks", "\x1f")})
    residual = [
        rest.select(RUN, "tasks", "size", "key", (F.col(a) - F.col(b)).alias("n")).where("n > 0")
        for a, b in (("nl", "nr"), ("nr", "nl"))
    ]
    pairs = couple(*residual, ["size", "key"], ["tasks"], RUN)
    pairs = pairs.select(RUN, F.col("l.tasks").alias("a"), F.col("r.tasks").alias("b"), "mass")
    scored = pairs.groupBy(RUN, "a", "b").agg(F.sum("mass").alias("n"))
    scored = scored.withColumn("s", similarity("a", "b"))
    summed = scored.groupBy(RUN).agg(F.sum(F.col("s") * F.col("n")).alias("s"))
    value = (F.coalesce("s", F.lit(0.0)) + F.col("same")) / F.greatest("cases", F.lit(1))
    return totals.join(summed, RUN, "left").select(RUN, value.alias("sim_val"))


def _timed_strings(log: DataFrame, runs: DataFrame, numbers: list[int], schema: LogSchema) -> DataFrame:
    fields = schema.times
    sides, tops, sizes = [], [], []
    for x, by in ((log, ()), (runs, (RUN,))):
        timed = add_calculated_times(x, schema)
        top = timed.groupBy(*by).agg(*[F.max(f).alias(f) for f in fields])
        tops.append(top if by else _for_each(top, numbers))
        traces = _traces(timed, schema, fields, by)
        traces = null_safe_join(traces, cycle_times(x, schema, by), [*by, "caseid"])
        traces = pin(traces.withColumns({"size": F.size("tasks"), "key": F.array_join("tasks", "\x1f")}))
        order = ["size", "key", "cycle_us", "caseid"]
        if by:
            sizes.append(traces.groupBy(RUN).agg(F.count(F.lit(1)).alias("n")))
            ranked = number_rows(traces, [RUN], order, "rank")
        else:
            count = traces.count()
            sizes.append(_for_each(log.sparkSession.range(1).select(F.lit(count).alias("n")), numbers))
            ranked = global_rank(traces, order, "rank", count)
        ranked = ranked.select(*by, "rank", F.struct(F.col("tasks").alias("task"), *fields).alias("side"))
        sides.append(ranked.withColumnRenamed("side", "r" if by else "l"))
    top = tops[0].unionByName(tops[1]).groupBy(RUN).agg(*[F.max(f).alias(f"_{f}") for f in fields])
    pairs = sides[1].join(sides[0], "rank").join(F.broadcast(top), RUN)  # a row for each run

    def shares(side):
        share = lambda f: F.transform(
            F.col(side)[f], lambda v: F.coalesce(F.try_divide(v, F.col(f"_{f}")), F.lit(0.0))
        )
        zero = F.transform(F.col(side)["task"], lambda v: F.lit(0.0))
        times = {f: share(f) if f in fields else zero for f in ("dur", "wait")}
        return F.struct(F.col(side)["task"].alias("task"), *[c.alias(f) for f, c in times.items()])

    scaled = pairs.select(RUN, shares("l").alias("l"), shares("r").alias("r"))
    summed = scaled.withColumn("s", timed_similarity("l", "r")).groupBy(RUN).agg(F.sum("s").alias("s"))
    most = sizes[0].unionByName(sizes[1]).groupBy(RUN).agg(F.max("n").alias("n"))
    value = F.coalesce("s", F.lit(0.0)) / F.greatest("n", F.lit(1))
    return most.join(summed, RUN, "left").select(RUN, value.alias("sim_val"))


def _day_hours(log: DataFrame, runs: DataFrame, numbers: list[int], schema: LogSchema) -> DataFrame:
    def histogram(x, by, sign):
        cells = x.select(*by, weekday(schema.key).alias("weekday"), F.hour(schema.key).alias("hour"))
        counts = cells.groupBy(*by, "weekday", "hour").agg(F.count(F.lit(1)).alias("n"))
        share = F.col("n") / F.sum("n").over(W.partitionBy(*by))  # at most 168 rows of a run
        return counts.select(*by, "weekday", "hour", (share * sign).alias("share"))

    grid = log.sparkSession.range(168).select(
        F.expr("cast(id div 24 as int)").alias("weekday"),
        F.expr("cast(id % 24 as int)").alias("hour"),
        F.lit(0.0).alias("share"),
    )
    own = _for_each(histogram(log, (), 1).unionByName(grid), numbers)
    cells = own.unionByName(histogram(runs, (RUN,), -1))
    cells = cells.groupBy(RUN, "weekday", "hour").agg(F.sum("share").alias("d"))
    moved = F.abs(F.sum("d").over(W.partitionBy(RUN, "weekday").orderBy("hour")))
    days = cells.withColumn("moved", moved).groupBy(RUN, "weekday").agg(F.sum("moved").alias("emd"))
    return days.groupBy(RUN).agg(F.avg("emd").alias("sim_val"))


_BY_RUN = {
    "tsd": _timed_strings, "day_hour_emd": _day_hours, "log_mae": _log_mae, "dl": _control_flow,
    "mae": _cycle_mae,
}


def _of_one(metric: str, log: DataFrame, sim: DataFrame, schema: LogSchema) -> DataFrame:
    return _BY_RUN[metric](log, sim.withColumn(RUN, F.lit(0)), [0], schema).select("sim_val")


def log_mae(log: DataFrame, sim: DataFrame, schema: LogSchema = LogSchema()) -> DataFrame:
    """Difference of the mean cycle times, in seconds."""
    return _of_one("log_mae", log, sim, schema)


def cycle_mae(log: DataFrame, sim: DataFrame, schema: LogSchema = LogSchema()) -> DataFrame:
    """Mean difference of cycle times paired by rank, in seconds."""
    return _of_one("mae", log, sim, schema)


def control_flow_similarity(
    log: DataFrame, sim: DataFrame, schema: LogSchema = LogSchema()
) -> DataFrame:
    """Mean similarity of paired cases by their activity sequences.

    Cases with equal sequences are paired first; what is left is paired in the
    order (length, sequence). Unpaired cases count as 0.
    """
    return _of_one("dl", log, sim, schema)


def timed_string_similarity(
    log: DataFrame, sim: DataFrame, schema: LogSchema = LogSchema()
) -> DataFrame:
    """Mean similarity of cases paired by rank, times included.

    Both logs are ranked by (length, sequence, cycle time, case); keeping an
    activity costs half its difference in duration and in wait, each as a share
    of the largest in either log. Unpaired cases count as 0.
    """
    return _of_one("tsd", log, sim, schema)


def day_hour_emd(log: DataFrame, sim: DataFrame, schema: LogSchema = LogSchema()) -> DataFrame:
    """Earth mover's distance of the hourly histograms, averaged over weekdays."""
    return _of_one("day_hour_emd", log, sim, schema)


METRICS = {
    "tsd": timed_string_similarity,
    "day_hour_emd": day_hour_emd,
    "log_mae": log_mae,
    "dl": control_flow_similarity,
    "mae": cycle_mae,
}


def compare_logs(
    log: DataFrame, runs: DataFrame, schema: LogSchema = LogSchema(), metrics=tuple(METRICS)
) -> DataFrame:
    """(run_num, metric, sim_val): each run of a generated log against ``log``.

    ``runs`` has ``run_num``; its events need the schema's order columns. All runs go
    through one plan for each metric, whatever their number.
    """
    log = pin(prefix_cases(drop_sentinels(log)))
    own_case = F.concat_ws("\x1f", F.col(RUN), F.col("caseid"))
    runs = pin(drop_sentinels(runs).withColumn("caseid", own_case))
    numbers = sorted(r[0] for r in runs.select(RUN).distinct().collect())  # repetitions
    tables = [
        _BY_RUN[m](log, runs, numbers, schema).select(RUN, F.lit(m).alias("metric"), "sim_val") for m in metrics
    ]
    return reduce(DataFrame.unionByName, tables)
