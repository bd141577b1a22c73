"""Trace series and training, next-event and prefix/suffix samples.

Codes: 0 is both padding and ``start``; numeric columns are 0 at the sentinels.
A sample's ``cut`` is the number of events before its label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.arrays import one_hot, pad_last
from logloom.operators.positions import SEGMENT_ROWS, Frame, over_traces, placed_in_cases
from logloom.schema import LogSchema

INDEXES = ("ac_index", "rl_index")
# Events of a part of a trace; the cuts within one part are expanded by one task.
PART_EVENTS = 512


def _typed(columns: list[str]) -> list[Column]:
    """Indexes and weekday as INT, everything else as DOUBLE."""
    whole = (*INDEXES, "weekday")
    return [F.col(c).cast("int" if c in whole else "double").alias(c) for c in columns]


def _zero(column: str) -> Column:
    return F.lit(0) if column in (*INDEXES, "weekday") else F.lit(0.0)


def _ends(columns: list[str], ends: dict[str, int]) -> list[Column]:
    """Values at the ``end`` sentinel."""
    return [F.lit(ends[c]) if c in ends else _zero(c) for c in columns]


def _series(log: DataFrame, columns: list[str], schema: LogSchema, size: int) -> DataFrame:
    """(caseid, part, last_part, <column> arrays) of ``size`` events, without sentinels."""
    placed = placed_in_cases(log, schema.order, "_pos", "_n")
    number = lambda c, name: F.expr(f"cast(({c} - 1) div {size} as int)").alias(name)
    events = F.sort_array(F.collect_list(F.struct("_pos", F.struct(*_typed(columns)).alias("_v"))))
    keys = ["caseid", number("_pos", "part"), number("_n", "last_part")]
    traces = placed.groupBy(*keys).agg(events["_v"].alias("_e"))
    return traces.select("caseid", "part", "last_part", *[F.col(f"_e.{c}").alias(c) for c in columns])


def to_traces(
    log: DataFrame, columns: list[str], ends: dict[str, int], schema: LogSchema = LogSchema()
) -> DataFrame:
    """One array per column and case, sentinels included.

    ``ends`` maps the index columns to their ``end`` code. Every case comes in
    consecutive parts of SEGMENT_ROWS events, so all but very long ones in one.
    """
    traces = _series(log, columns, schema, SEGMENT_ROWS)
    none = F.col("part") < F.col("last_part")

    def closed(column: str, end: Column) -> Column:
        kind = "array<int>" if column in (*INDEXES, "weekday") else "array<double>"
        empty = F.array().cast(kind)
        head = F.when(F.col("part") == 0, F.array(_zero(column))).otherwise(empty)
        tail = F.when(none, empty).otherwise(F.array(end))
        return F.concat(head, F.col(column), tail).alias(column)

    closing = [closed(c, e) for c, e in zip(columns, _ends(columns, ends))]
    return traces.select("caseid", "part", *closing)


def _prefixed(columns: list[str], prefix: Column, label: Column) -> list[Column]:
    return [
        *[prefix[c].alias(f"{c}_prefix") for c in columns],
        *[label[c].alias(f"{c}_next") for c in columns],
    ]


def windowed_samples(
    log: DataFrame,
    columns: list[str],
    n: int,
    ends: dict[str, int],
    schema: LogSchema = LogSchema(),
    include_end: bool = True,
    hot: list[int] | None = None,
) -> DataFrame:
    """One row per label: the ``n`` values before it, left-padded with 0.

    Windows look back ``n`` rows only, so cases of any length are fine. With
    ``include_end`` the closing sentinel is a label too.
    """
    values = F.struct(*_typed(columns))
    zeros = F.struct(*[_zero(c).alias(c) for c in columns])
    closing = F.struct(*[e.alias(c) for c, e in zip(columns, _ends(columns, ends))])

    def neighbours(frame: Frame) -> dict[str, Column]:
        built = {"_cut": frame.pos - 1, "_seen": F.collect_list(values).over(frame.span(-n, 0))}
        if include_end:
            built["_last"] = frame.is_last
        return built

    seen = over_traces(log, schema, neighbours, back=n, ahead=1, hot=hot)
    before = F.slice("_seen", F.lit(1), F.size("_seen") - 1)
    samples = F.array(
        F.struct(F.col("_cut").alias("cut"), pad_last(before, n, zeros).alias("p"),
                 F.element_at("_seen", -1).alias("y"))
    )
    if include_end:
        final = F.array(
            F.struct((F.col("_cut") + 1).alias("cut"), pad_last(F.col("_seen"), n, zeros).alias("p"),
                     closing.alias("y"))
        )
        samples = F.when(F.col("_last"), F.concat(samples, final)).otherwise(samples)
    rows = seen.select("caseid", F.explode(samples).alias("s"))
    return rows.select("caseid", "s.cut", *_prefixed(columns, F.col("s.p"), F.col("s.y")))


def ngram_samples(log, columns, n, ends, schema=LogSchema(), hot=None) -> DataFrame:
    """Training samples: L+1 rows for a case of L events, ``end`` included."""
    return windowed_samples(log, columns, n, ends, schema, True, hot)


def _located(parts: DataFrame, columns: list[str], tails: bool) -> DataFrame:
    """The parts with what lies before them in their case and, if asked for, after them.

    Adds arrays ``<column>_head`` and ``<column>_tail``. A case of one part has nothing
    around it. The parts of a longer case are sent to each part that they precede (or
    follow), so its parts are completed in tasks of their own.
    """

    def none(name):
        return F.slice(name, 1, 0)

    around = [*[(c, "head") for c in columns], *[(c, "tail") for c in columns if tails]]
    alone = parts.where("last_part = 0")
    alone = alone.select("*", *[none(c).alias(f"{c}_{side}") for c, side in around])
    sent = parts.where("last_part > 0").select(
        "caseid",
        "last_part",
        F.struct("part", *columns).alias("_p"),
        F.explode(F.sequence(F.lit(0) if tails else F.col("part"), F.col("last_part"))).alias("_at"),
    )
    met = sent.repartition("caseid", "_at").groupBy("caseid", "_at", "last_part")
    met = met.agg(F.sort_array(F.collect_list("_p")).alias("_all"))
    picks = {
        "head": F.filter("_all", lambda p: p["part"] < F.col("_at")),
        "tail": F.filter("_all", lambda p: p["part"] > F.col("_at")),
    }
    own = F.filter("_all", lambda p: p["part"] == F.col("_at"))[0]
    many = met.select(
        "caseid",
        F.col("_at").alias("part"),
        "last_part",
        *[own[c].alias(c) for c in columns],
        *[F.flatten(picks[side][c]).alias(f"{c}_{side}") for c, side in around],
    )
    return alone.unionByName(many)


def _cuts(log, columns, schema, include_end: bool, tails: bool) -> DataFrame:
    """A row for each cut: its part, what lies around the part, and ``cut`` and ``_k``.

    ``_k`` is the number of events of the part before the cut. Only what is selected from
    these rows is as long as the case; the rows of a part share one input row.
    """
    located = _located(_series(log, columns, schema, PART_EVENTS), columns, tails)
    size = F.size(columns[0])
    top = size - 1
    if include_end:
        top = F.when(F.col("part") == F.col("last_part"), size).otherwise(size - 1)
    rows = located.withColumn("_k", F.explode(F.sequence(F.lit(0), top)))
    return rows.withColumn("cut", F.col("part") * PART_EVENTS + F.col("_k"))


def _prefix(column: str) -> Column:
    inside = F.slice(column, F.lit(1), F.col("_k"))
    return F.concat(F.array(_zero(column)), F.col(f"{column}_head"), inside)


def next_event_samples(
    log, columns, ends, schema=LogSchema(), include_end: bool = False
) -> DataFrame:
    """Growing prefixes and the value after them, for cases of any length.

    L rows per case, ``end`` is no label unless ``include_end``.
    """
    cuts = _cuts(log, columns, schema, include_end, tails=False)
    last = F.col("_k") == F.size(columns[0])
    labels = [
        F.when(last, end).otherwise(F.get(F.col(c), F.col("_k"))).alias(f"{c}_next")
        for c, end in zip(columns, _ends(columns, ends))
    ]
    return cuts.select("caseid", "cut", *[_prefix(c).alias(f"{c}_prefix") for c in columns], *labels)


def suffix_samples(log, columns, ends, schema=LogSchema()) -> DataFrame:
    """Every cut of a case into prefix and suffix; L+1 rows, ``end`` included.

    Cases may have any length.
    """
    cuts = _cuts(log, columns, schema, include_end=True, tails=True)
    suffixes = [
        F.concat(
            F.slice(c, F.col("_k") + 1, F.size(c) - F.col("_k")), F.col(f"{c}_tail"), F.array(end)
        ).alias(f"{c}_suffix")
        for c, end in zip(columns, _ends(columns, ends))
    ]
    return cuts.select("caseid", "cut", *[_prefix(c).alias(f"{c}_prefix") for c in columns], *suffixes)


def stack_features(samples: DataFrame, columns: list[str], suffix="prefix") -> DataFrame:
    """Adds ``tensor``: per step the listed features, weekday one-hot and last."""
    plain = [c for c in columns if c != "weekday"]
    fields = [F.col(f"{c}_{suffix}").alias(c) for c in columns]
    step_values = lambda s: F.concat(
        F.array(*[s[c].cast("double") for c in plain]),
        *([one_hot(s["weekday"], 7).cast("array<double>")] if "weekday" in columns else []),
    )
    return samples.withColumn("tensor", F.transform(F.arrays_zip(*fields), step_values))


def one_hot_labels(samples: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """Replaces the index labels by 0/1 arrays of the given sizes."""
    return samples.withColumns({f"{c}_next": one_hot(F.col(f"{c}_next"), n) for c, n in sizes.items()})
