"""Variable-order n-gram model of the next event, and its state table.

The model counts, for every context of the last k activities (k = 0..n), the
next activities and roles, and keeps the median times of each transition. A
prediction backs off to the longest context with enough support.

``states`` folds this into an automaton: one row per supported context with its
choices, each with the state it leads to. The state after a step is found at
fit time: support never grows with the length of a context, so the longest
supported suffix of (history, next) is a suffix of (state, next). Predicting a
step is then one equi-join on the state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logloom.functions.arrays import pad_last
from logloom.functions.draws import uniform
from logloom.operators.positions import grouped_medians, hot_counted
from logloom.runtime import pin

ARG_MAX, RANDOM_CHOICE = "arg_max", "random_choice"
VARIANTS = (ARG_MAX, RANDOM_CHOICE)


def check_variant(variant: str) -> str:
    if variant not in VARIANTS:
        raise ValueError(variant)
    return variant


def context_key(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")


def _suffixes(values: Column, longest) -> Column:
    """Keys of the last 0..longest elements, with their lengths."""
    lengths = F.sequence(F.lit(0), longest if isinstance(longest, Column) else F.lit(longest))
    return F.transform(
        lengths,
        lambda k: F.struct(
            k.alias("k"),
            context_key(F.slice(values, F.size(values) - k + 1, k)).alias("ctx"),
        ),
    )


def count_contexts(samples: DataFrame, label: str, n: int) -> DataFrame:
    """(k, ctx, next, n, total): counts of each next value per context.

    Rows are first counted per full context; the shorter ones are rolled up
    from those counts, so the explosion runs over distinct contexts only.
    """
    full = samples.groupBy("ac_index_prefix", F.col(label).alias("next")).agg(
        F.count(F.lit(1)).alias("n")
    )
    parts = full.select("next", "n", F.explode(_suffixes(F.col("ac_index_prefix"), n)).alias("c"))
    counts = parts.groupBy("c.k", "c.ctx", "next").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy("k", "ctx"))
    return counts.withColumn("total", total)


def ngram_table(samples: DataFrame, label: str, n: int) -> DataFrame:
    """``count_contexts`` with the probability ``p`` of each next value."""
    return count_contexts(samples, label, n).withColumn("p", F.col("n") / F.col("total"))


def time_table(
    samples: DataFrame, times: list[str], n: int, counts: DataFrame | None = None
) -> DataFrame:
    """(k, ctx, next, <time> medians): the lower median per transition.

    ``counts`` is the ``count_contexts`` table of the activities, if known; it
    tells which transitions hold a large part of the log.
    """
    labels = [F.col(f"{t}_next").alias(t) for t in times]
    rows = samples.select(
        F.explode(_suffixes(F.col("ac_index_prefix"), n)).alias("c"),
        F.col("ac_index_next").alias("next"),
        *labels,
    ).select("c.k", "c.ctx", "next", *times)
    group = ["k", "ctx", "next"]
    hot = hot_counted(counts, group, "n") if counts is not None else None
    return grouped_medians(rows, group, times, hot)


@dataclass(frozen=True)
class NgramModel:
    """``states``: ctx, k, total, ac and rl choices in index order, best."""

    states: DataFrame
    n: int
    end: int
    times: tuple[str, ...]


def _choices(counts: DataFrame, fields: list[str], out: str) -> DataFrame:
    """Per context: the choices by index with their running count ``upto``."""
    upto = F.sum("n").over(
        W.partitionBy("ctx").orderBy("next").rowsBetween(W.unboundedPreceding, 0)
    )
    packed = F.struct("next", "n", "upto", *fields)
    listed = F.sort_array(F.collect_list(packed)).alias(out)  # one per activity or role
    return counts.withColumn("upto", upto).groupBy("k", "ctx", "total").agg(listed)


def fit_ngrams(
    samples: DataFrame, n: int, end: int, times: list[str], min_support: int = 1
) -> NgramModel:
    """Fits on pinned training samples of ``ac_index``, ``rl_index`` and times."""
    supported = (F.col("total") >= min_support) | (F.col("k") == 0)
    ac = pin(count_contexts(samples, "ac_index_next", n).where(supported))
    rl = count_contexts(samples, "rl_index_next", n).where(supported)
    medians = time_table(samples, times, n, ac)
    contexts = ac.select(F.col("k").alias("to_k"), F.col("ctx").alias("to")).distinct()
    moved = F.filter(F.concat(F.split("ctx", ","), F.array(F.col("next").cast("string"))), lambda v: v != "")
    steps = ac.where(F.col("next") != end).select(
        "ctx", "next", F.explode(_suffixes(moved, F.least(F.col("k") + 1, F.lit(n)))).alias("c")
    )
    reached = (
        steps.join(contexts, F.col("c.ctx") == F.col("to"))
        .groupBy("ctx", "next")
        .agg(F.max_by("to", "to_k").alias("to"))
    )
    rich = ac.join(reached, ["ctx", "next"], "left").join(medians.drop("k"), ["ctx", "next"], "left")
    ac_choices = _choices(rich, ["to", *times], "ac")
    rl_choices = _choices(rl, [], "rl").select("ctx", "rl")
    states = ac_choices.join(rl_choices, "ctx").select(
        "ctx", "k", "total", "ac", "rl", likeliest("ac").alias("best"),
        likeliest("rl")["next"].alias("best_rl"),
    )
    return NgramModel(pin(states), n, end, tuple(times))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` found once a row.

    A function of an array's elements finds whatever it is written with anew for each of them.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def likeliest(choices: str | Column) -> Column:
    """The choice with the largest count; the smallest index wins ties."""
    choices = F.col(choices) if isinstance(choices, str) else choices
    top = F.array_max(F.transform(choices, lambda c: c["n"]))
    return _once(top, lambda t: F.get(F.filter(choices, lambda c: c["n"] == t), F.lit(0)))


def drawn(choices: Column, u: Column) -> Column:
    """The choice whose share of the total count holds ``u``.

    Running counts are taken over ``choices`` itself, so a filtered list is
    renormalised.
    """
    mark = u * F.array_max(F.transform(choices, lambda c: c["upto"]))
    return _once(mark, lambda m: F.get(F.filter(choices, lambda c: c["upto"] > m), F.lit(0)))


def without(choices: Column, code: int) -> Column:
    """Choices other than ``code``, with running counts of their own."""
    skipped = F.aggregate(
        F.filter(choices, lambda c: c["next"] == code), F.lit(0).cast("bigint"), lambda a, c: a + c["n"]
    )
    kept = F.filter(choices, lambda c: c["next"] != code)

    def lowered(less: Column) -> Column:
        return F.transform(
            kept,
            lambda c: c.withField(
                "upto", F.when(c["next"] > code, c["upto"] - less).otherwise(c["upto"])
            ),
        )

    return _once(skipped, lowered)


def resolve(prefixes: DataFrame, model: NgramModel) -> DataFrame:
    """(window, state): the state of each distinct window of n activities."""
    windows = prefixes.select("window").distinct()
    parts = windows.select("window", F.explode(_suffixes(F.col("window"), model.n)).alias("c"))
    states = model.states.select("ctx", "k")
    found = parts.join(states, F.col("c.ctx") == F.col("ctx"))
    return found.groupBy("window").agg(F.max_by("ctx", "k").alias("state"))


def attach_states(samples: DataFrame, model: NgramModel, columns: list[str]) -> DataFrame:
    """Adds ``state`` and the listed state columns to samples with a prefix.

    Windows repeat far more often than they differ: they are resolved once per
    distinct window and joined back.
    """
    window = pad_last(F.col("ac_index_prefix"), model.n, F.lit(0))
    samples = samples.withColumn("window", window)
    states = model.states.select(F.col("ctx").alias("state"), *columns)
    known = pin(resolve(samples, model).join(states, "state"))
    return samples.join(known, "window").drop("window")


def predict_next(
    samples: DataFrame, model: NgramModel, variant: str = ARG_MAX, seed: int = 0, run: int = 0
) -> DataFrame:
    """Adds ``ac_pred``, ``rl_pred`` and ``<time>_pred`` to the samples."""
    if check_variant(variant) == ARG_MAX:
        rows = attach_states(samples, model, ["best", "best_rl"])
        ac, rl = F.col("best"), F.col("best_rl")
    else:
        rows = attach_states(samples, model, ["ac", "rl"])
        keys = [F.col("caseid"), F.col("cut"), f"{seed}-{run}"]
        ac = drawn(F.col("ac"), uniform(F.lit("ac"), *keys))
        rl = drawn(F.col("rl"), uniform(F.lit("rl"), *keys))["next"]
    rows = rows.withColumns({"_ac": ac, "rl_pred": rl})
    rows = rows.withColumns({f"{t}_pred": F.col(f"_ac.{t}") for t in model.times})
    rows = rows.withColumn("ac_pred", F.col("_ac.next"))
    return rows.drop("_ac", "best", "best_rl", "ac", "rl")
