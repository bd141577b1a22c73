"""Following the model for many steps: suffixes and generated logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.draws import uniform
from logloom.functions.scaling import rescaled
from logloom.functions.times import add_micros, add_seconds, to_micros, weekday
from logloom.operators.encode import CategoryIndex, decode
from logloom.operators.ngram import (
    ARG_MAX,
    RANDOM_CHOICE,
    NgramModel,
    attach_states,
    check_variant,
    drawn,
    likeliest,
    resolve,
    without,
)
from logloom.runtime import pin, pin_at, shared_folder
from logloom.schema import START_LABEL, LogSchema

# Steps planned as one job before the loop's state is pinned.
STEPS_PER_PIN = 4
# Copies of a state in which many walkers may be at once, so that they meet it in many tasks.
SALTS = 32


def likeliest_paths(model: NgramModel, max_steps: int) -> DataFrame:
    """(state, loop, ac, rl, <time>): the arg-max continuation of each state.

    The arg-max step maps a state to one state, so a continuation runs into a cycle or
    ends. The arrays go through each state once; ``loop`` is the place (from 0) where they
    start over, null where the continuation ends at ``end`` (included). So they are as
    long as the model has them, however long the longest case is. Paths are composed:
    each round joins four of them end to end.
    """
    parts = ["ac", "rl", *model.times]
    paths = model.states.select(
        F.col("ctx").alias("state"),
        F.lit(None).cast("int").alias("loop"),
        F.array("best.next").alias("ac"),
        F.array("best_rl").alias("rl"),
        *[F.array(f"best.{t}").alias(t) for t in model.times],
        F.array("ctx").alias("_seen"),
        F.col("best.to").alias("to"),
    )
    paths = pin(paths)
    while not paths.where((F.size("_seen") < max_steps) & F.col("to").isNotNull()).isEmpty():
        longer = paths
        for _ in range(3):
            more = paths.select(
                F.col("state").alias("_from"),
                *[F.col(p).alias(f"_{p}") for p in ["loop", *parts]],
                F.col("_seen").alias("_more"),
                F.col("to").alias("_to"),
            )
            longer = _joined(longer.join(more, F.col("to") == F.col("_from"), "left"), parts)
        paths = pin(longer)
    return paths.drop("_seen", "to")


def _joined(rows: DataFrame, parts: list[str]) -> DataFrame:
    """Paths with those they lead to appended; closed at the first state met again."""
    went_on = F.col("_from").isNotNull()
    both = F.when(went_on, F.concat("_seen", "_more")).otherwise(F.col("_seen"))
    rows = rows.withColumn("_both", both).withColumn("_once", F.array_distinct("_both"))
    met_again = F.size("_once") < F.size("_both")
    first = F.array_position("_once", F.get(F.col("_both"), F.size("_once"))).cast("int") - 1
    loop = F.when(went_on & met_again, first).when(went_on, F.size("_seen") + F.col("_loop"))
    grown = [
        F.when(went_on, F.slice(F.concat(p, f"_{p}"), 1, F.size("_once"))).otherwise(F.col(p)).alias(p)
        for p in parts
    ]
    return rows.select(
        "state",
        F.coalesce("loop", loop).alias("loop"),
        *grown,
        F.col("_once").alias("_seen"),
        F.when(~met_again, F.col("_to")).alias("to"),
    )


def unrolled(values: Column, loop: Column, steps: int) -> Column:
    """The first ``steps`` elements of a path that starts over at ``loop``, if it does."""
    size = F.size(values)
    length = F.when(loop.isNull(), F.least(size, F.lit(steps))).otherwise(F.lit(steps))
    place = lambda i: F.when(i < size, i).otherwise(loop + (i - size) % (size - loop))
    walked = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.get(values, place(i)))
    return F.when(loop.isNull(), F.slice(values, 1, length)).otherwise(walked)


def predict_suffixes(
    samples: DataFrame,
    model: NgramModel,
    max_trace_size: int,
    variant: str = ARG_MAX,
    seed: int = 0,
    run: int = 0,
) -> DataFrame:
    """Adds ``ac_pred``, ``rl_pred`` and ``<time>_pred`` arrays to the samples."""
    steps = max(max_trace_size - 1, 1)
    names = {"ac": "ac_pred", "rl": "rl_pred", **{t: f"{t}_pred" for t in model.times}}
    if check_variant(variant) == ARG_MAX:
        paths = pin(likeliest_paths(model, steps))
        states = attach_states(samples, model, [])
        rows = states.join(paths.withColumnsRenamed(names), "state")
        ends = {name: unrolled(F.col(name), F.col("loop"), steps) for name in names.values()}
        return rows.withColumns(ends).drop("state", "loop")
    rows = pin(attach_states(samples, model, []))
    walkers = rows.select(F.struct("caseid", "cut").alias("id"), "state")
    keys = [F.col("id.caseid"), F.col("id.cut")]
    walked = walk(walkers, model, steps, variant, keys, f"{seed}-{run}", first_open=False)
    # the arrays are what is asked for; they are put together once, at the end
    in_order = F.sort_array(F.collect_list(F.struct("pos", *[F.col(f"e.{p}").alias(p) for p in names])))
    walked = walked.groupBy("id").agg(in_order.alias("events"))
    found = walked.select(
        "id.*", *[F.col(f"events.{part}").alias(name) for part, name in names.items()]
    )
    return rows.drop("state").join(found, ["caseid", "cut"])


def walk(
    walkers: DataFrame,
    model: NgramModel,
    max_steps: int,
    variant: str,
    keys: list[Column],
    salt: str,
    first_open: bool,
    clock: Callable[[dict[str, Column], int], tuple[dict, dict]] | None = None,
    timed_states: DataFrame | None = None,
    start: list | None = None,
) -> DataFrame:
    """(id, pos, e): the events of all walkers (``id``, ``state``, ...), moved step by step.

    ``first_open`` keeps ``end`` from being the first event. ``clock(event,
    step)`` returns fields to add to the event and new values of the walkers'
    own columns. With ``timed_states`` the choices seen at the hour and weekday
    of column ``now`` replace those of the state. Walkers that reached ``end``
    leave the loop, so no step joins on their missing state.

    Some steps are one job, which writes the walkers with the events of these steps only,
    so every event is written once. ``start`` are states that many walkers start from.
    """
    states = model.states.select(F.col("ctx").alias("state"), "ac", "rl")
    start = start or []
    hot = start + _frequent(states)
    states = _copied(states, hot, "_salt")
    if timed_states is not None:
        timed_states = timed_states.select(
            F.col("ctx").alias("state"), "_hour", "_weekday", F.col("ac").alias("_timed")
        )
        timed_states = _copied(timed_states, start, "_salt_timed")
    folder = f"{shared_folder(walkers.sparkSession)}/walks/{uuid.uuid4().hex}"
    rows, step, block = walkers, 0, 0
    while step < max_steps:
        last = min(step + STEPS_PER_PIN, max_steps)
        for step in range(step + 1, last + 1):
            rows = rows.withColumns({"_salt": _salt(hot), "_salt_timed": _salt(start)})
            rows = _advance(rows, states, model, step, variant, keys, salt,
                            first_open and step == 1, clock, timed_states)
        moved = pin_at(rows, f"{folder}/block={block}")
        rows = moved.where("state is not null").drop("events")
        if step < max_steps and rows.isEmpty():
            break
        block += 1
    written = T.StructType([*moved.schema, T.StructField("block", T.IntegerType())])
    blocks = walkers.sparkSession.read.schema(written).parquet(folder)
    events = blocks.select("id", "block", F.posexplode("events").alias("pos", "e"))
    return events.select("id", (F.col("block") * STEPS_PER_PIN + F.col("pos")).alias("pos"), "e")


def _frequent(states: DataFrame) -> list:
    """The states with at least one in SALTS of the counted events: so many of each length."""
    events = F.element_at("ac", -1)["upto"]
    most = states.agg(F.max(events)).first()[0] or 0
    return [r["state"] for r in states.where(events * SALTS >= most).select("state").collect()]


def _copied(states: DataFrame, hot: list, salt: str) -> DataFrame:
    """SALTS rows for each of the states ``hot``, numbered by ``salt``; one for the others."""
    copies = F.when(F.col("state").isin(hot), F.lit(SALTS)).otherwise(F.lit(1))
    return states.withColumn(salt, F.explode(F.sequence(F.lit(0), copies - 1)))


def _salt(hot: list) -> Column:
    """The copy of its state that a walker meets."""
    spread = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    return F.when(F.col("state").isin(hot), spread).otherwise(F.lit(0))


def _advance(rows, states, model, step, variant, keys, salt, first_open, clock, timed_states):
    own = [c for c in rows.columns if c not in ("state", "events", "_salt", "_salt_timed")]
    rows = rows.join(states, ["state", "_salt"], "left")
    choices = F.col("ac")
    if timed_states is not None:
        rows = rows.withColumns({"_hour": F.hour("now"), "_weekday": weekday("now")})
        rows = rows.join(timed_states, ["state", "_hour", "_weekday", "_salt_timed"], "left")
        choices = F.coalesce("_timed", "ac")
    if first_open:
        choices = without(choices, model.end)
    if variant == ARG_MAX:
        ac, rl = likeliest(choices), likeliest("rl")
    else:
        ac = drawn(choices, uniform(F.lit("ac"), *keys, F.lit(step), salt))
        rl = drawn(F.col("rl"), uniform(F.lit("rl"), *keys, F.lit(step), salt))
    rows = rows.withColumns({"_ac": ac, "_rl": rl["next"]})
    event = {"ac": F.col("_ac.next"), "rl": F.col("_rl")}
    event |= {t: F.col(f"_ac.{t}") for t in model.times}
    fields, updates = clock(event, step) if clock else ({}, {})
    packed = F.array(F.struct(*[c.alias(name) for name, c in (event | fields).items()]))
    active = F.col("state").isNotNull()
    if "events" in rows.columns:
        packed = F.when(active, F.concat("events", packed)).otherwise(F.col("events"))
    kept = [
        F.when(active, updates[c]).otherwise(F.col(c)).alias(c) if c in updates else F.col(c)
        for c in own
    ]
    return rows.select(*kept, packed.alias("events"), F.col("_ac.to").alias("state"))


def timed_choices(samples: DataFrame, model: NgramModel, min_support: int = 1) -> DataFrame:
    """(ctx, hour, weekday, ac): choices per state and clock of the last event.

    ``samples`` carry ``daytime_prefix`` (seconds) and ``weekday_prefix``.
    """
    rows = attach_states(samples, model, []).select(
        F.col("state").alias("ctx"),
        F.expr("cast(element_at(daytime_prefix, -1) as int) div 3600").cast("int").alias("_hour"),
        F.element_at("weekday_prefix", -1).alias("_weekday"),
        F.col("ac_index_next").alias("next"),
    )
    group = ["ctx", "_hour", "_weekday"]
    counts = rows.groupBy(*group, "next").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy(*group).orderBy("next")
    counts = counts.withColumns(
        {
            "upto": F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0)),
            "total": F.sum("n").over(W.partitionBy(*group)),
        }
    ).where(F.col("total") >= min_support)
    known = model.states.select("ctx", F.explode("ac").alias("c"))
    fields = ["to", *model.times]
    known = known.select("ctx", F.col("c.next").alias("next"), *[F.col(f"c.{f}") for f in fields])
    packed = F.struct("next", "n", "upto", *fields)
    listed = F.sort_array(F.collect_list(packed)).alias("ac")  # one per activity
    return pin(counts.join(known, ["ctx", "next"]).groupBy(*group).agg(listed))


def generate_log(
    model: NgramModel,
    num_cases: int,
    start_time: datetime,
    max_trace_size: int,
    activities: CategoryIndex,
    roles: CategoryIndex,
    scale_args: dict,
    norm_method: str | None,
    schema: LogSchema = LogSchema(),
    variant: str = RANDOM_CHOICE,
    seed: int = 0,
    run: int = 0,
    timed_states: DataFrame | None = None,
) -> DataFrame:
    """Synthetic event log of ``num_cases`` cases, grown from empty prefixes.

    With ``timed_states`` each step looks at the running clock, a case keeps
    its ``start`` and ``end`` rows and may end at once.
    """
    spark = model.states.sparkSession
    context = timed_states is not None
    digits = len(str(num_cases))
    t0 = F.lit(start_time).cast("timestamp_ntz")
    start_window = F.array_repeat(F.lit(0), model.n)
    first = resolve(spark.range(1).select(start_window.alias("window")), model).first()["state"]
    cases = spark.range(num_cases).select(
        F.concat(F.lit("Case"), F.lpad(F.col("id").cast("string"), digits, "0")).alias("id"),
        F.lit(first).alias("state"),
        t0.alias("now"),
        t0.alias("until"),
    )
    clock = _point_clock if schema.one_timestamp else _interval_clock
    walked = walk(
        cases, model, max(max_trace_size - 1, 1), check_variant(variant), [F.col("id")],
        f"{seed}-{run}", not context, clock(scale_args, norm_method), timed_states, [first],
    )
    rows = walked.select(F.col("id").alias("caseid"), F.col("pos").cast("bigint").alias("pos"), "e.*")
    if not context:
        rows = rows.where(F.col("ac") != model.end)
    rows = decode(decode(rows, activities, "ac", "task"), roles, "rl", "role")
    if schema.one_timestamp:
        columns = ["end_timestamp", F.col("dur").alias("tbtw_raw"), "tbtw"]
    else:
        columns = ["start_timestamp", "end_timestamp", F.col("dur").alias("dur_raw"), "dur_s",
                   F.col("wait").alias("wait_raw"), "wait_s"]
    rows = rows.select("caseid", "pos", "task", "role", *columns)
    rows = rows.withColumnsRenamed({"dur_s": "dur", "wait_s": "wait"})
    return _with_start_rows(rows, cases, schema) if context else rows


def _with_start_rows(rows, cases, schema):
    stamps = ["end_timestamp"] if schema.one_timestamp else ["start_timestamp", "end_timestamp"]
    starts = cases.select(
        F.col("id").alias("caseid"), F.lit(-1).cast("bigint").alias("pos"),
        F.lit(START_LABEL).alias("task"), F.lit(START_LABEL).alias("role"),
        *[F.col("now").alias(s) for s in stamps],
    )
    return rows.unionByName(starts, allowMissingColumns=True).withColumn("pos", F.col("pos") + 1)


def _interval_clock(scale_args, norm_method):
    def clock(event, step):
        seconds = {
            t: rescaled(F.greatest(event[t], F.lit(0.0)), scale_args[t], norm_method)
            for t in ("dur", "wait")
        }
        start = add_seconds("until", seconds["wait"])
        end = add_seconds(start, seconds["dur"])
        fields = {"dur_s": seconds["dur"], "wait_s": seconds["wait"],
                  "start_timestamp": start, "end_timestamp": end}
        return fields, {"now": start, "until": end}

    return clock


def _point_clock(scale_args, norm_method):
    def clock(event, step):
        gap = rescaled(event["dur"], scale_args["dur"], norm_method)
        # The first event sits exactly at the start; its gap is ignored.
        end = F.col("until") if step == 1 else add_seconds("until", gap)
        return {"tbtw": gap, "end_timestamp": end}, {"now": end, "until": end}

    return clock


def running_timestamps(log: DataFrame, start_time: datetime, schema: LogSchema) -> DataFrame:
    """Timestamps of generated traces from their ``dur`` and ``wait`` seconds.

    ``log(caseid, pos, dur[, wait])``; start = t0 + waits so far + earlier
    durations. Point mode puts the first event at t0 and adds the gaps.
    """
    t0 = F.lit(start_time).cast("timestamp_ntz")
    upto = W.partitionBy("caseid").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    if schema.one_timestamp:
        gap = F.when(F.row_number().over(W.partitionBy("caseid").orderBy("pos")) == 1, 0)
        gap = gap.otherwise(to_micros("dur"))
        log = log.withColumn("_gap", gap).withColumn("_at", F.sum("_gap").over(upto))
        return log.withColumn("end_timestamp", add_micros(t0, F.col("_at"))).drop("_gap", "_at")
    log = log.withColumns({"_d": to_micros("dur"), "_w": to_micros("wait")})
    end = add_micros(t0, F.sum(F.col("_d") + F.col("_w")).over(upto))
    log = log.withColumn("end_timestamp", end)
    start = add_micros("end_timestamp", -F.col("_d"))
    return log.withColumn("start_timestamp", start).drop("_d", "_w")
