"""The three predictive tasks: next event, suffix, whole log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.arrays import total
from logloom.functions.scaling import rescaled
from logloom.operators.encode import log_extent
from logloom.operators.evaluate import (
    accuracy, compare_logs, mae_next, mae_suffix, suffix_similarity,
)
from logloom.operators.features import sample_columns
from logloom.operators.ngram import ARG_MAX, RANDOM_CHOICE, NgramModel, predict_next
from logloom.operators.routing import RoutedModel, fit_routed, predict_routed
from logloom.operators.samples import (
    next_event_samples, ngram_samples, suffix_samples, windowed_samples,
)
from logloom.operators.walks import generate_log, predict_suffixes, timed_choices
from logloom.plans.training import Prepared, training_samples


def _seconds(prepared: Prepared, time: str):
    args, method = prepared.scale_args[time], prepared.norm_method
    return lambda value: rescaled(value, args, method)


def _names(prepared: Prepared, time: str) -> str:
    """Times are called ``tm`` in point mode."""
    return "tm" if prepared.schema.one_timestamp else time


def next_event_records(
    prepared: Prepared,
    model: NgramModel,
    variant: str = ARG_MAX,
    seed: int = 0,
    run: int = 0,
    whole_prefix: bool = False,
    include_end: bool = False,
) -> DataFrame:
    """Prefix, expected and predicted values per cut, times in seconds.

    The prefix holds the model's window, or with ``whole_prefix`` the case from
    its start.
    """
    columns, ends, schema = prepared.columns, prepared.ends, prepared.schema
    if whole_prefix:
        samples = next_event_samples(prepared.test, columns, ends, schema, include_end)
    else:
        samples = windowed_samples(prepared.test, columns, model.n, ends, schema, include_end, prepared.hot)
    rows = predict_next(samples, model, variant, seed, run)
    out = [
        "caseid", "cut", (F.col("cut") + 1).alias("pref_size"),
        F.col("ac_index_prefix").alias("ac_prefix"), F.col("ac_index_next").alias("ac_expect"), "ac_pred",
        F.col("rl_index_prefix").alias("rl_prefix"), F.col("rl_index_next").alias("rl_expect"), "rl_pred",
    ]
    for t in schema.times:
        seconds, name = _seconds(prepared, t), _names(prepared, t)
        out += [
            F.transform(f"{t}_norm_prefix", seconds).alias(f"{name}_prefix"),
            seconds(F.col(f"{t}_norm_next")).alias(f"{name}_expect"),
            seconds(F.col(f"{t}_pred")).alias(f"{name}_pred"),
        ]
    return rows.select(*out)


def routed_columns(prepared: Prepared) -> list[str]:
    clock = "daytime" if "daytime" in prepared.train.columns else "daytime_norm"
    return ["ac_index", "rl_index", *prepared.schema.times, clock, "weekday"]


def fit_heads(prepared: Prepared, n: int = 5, min_support: int = 1) -> RoutedModel:
    """A next-event model whose heads see what the prepared model type routes to them."""
    samples = training_samples(prepared, n, routed_columns(prepared))
    heads = prepared.spec.heads
    return fit_routed(samples, heads, n, prepared.activities.end, prepared.schema.times, min_support)


def routed_records(prepared: Prepared, model: RoutedModel) -> DataFrame:
    """Expected and predicted next events of the test part by the heads' own contexts."""
    samples = windowed_samples(
        prepared.test, routed_columns(prepared), model.n, prepared.ends, prepared.schema, False, prepared.hot
    )
    rows = predict_routed(samples, model)
    out = ["caseid", "cut", F.col("ac_index_next").alias("ac_expect"), "ac_pred",
           F.col("rl_index_next").alias("rl_expect"), "rl_pred"]
    for t in prepared.schema.times:
        name = _names(prepared, t)
        out += [F.col(f"{t}_next").alias(f"{name}_expect"), F.col(f"{t}_pred").alias(f"{name}_pred")]
    return rows.select(*out)


def suffix_records(
    prepared: Prepared, model: NgramModel, variant: str = ARG_MAX, seed: int = 0, run: int = 0
) -> DataFrame:
    """Prefix, expected and predicted suffix per cut, and the remaining time."""
    samples = suffix_samples(prepared.test, prepared.columns, prepared.ends, prepared.schema)
    rows = predict_suffixes(samples, model, prepared.max_trace_size, variant, seed, run)
    out = [
        "caseid", "cut", (F.col("cut") + 1).alias("pref_size"),
        F.col("ac_index_prefix").alias("ac_prefix"), F.col("ac_index_suffix").alias("ac_expect"), "ac_pred",
        F.col("rl_index_prefix").alias("rl_prefix"), F.col("rl_index_suffix").alias("rl_expect"), "rl_pred",
    ]
    for t in prepared.schema.times:
        seconds, name = _seconds(prepared, t), _names(prepared, t)
        out += [
            F.transform(f"{t}_norm_prefix", seconds).alias(f"{name}_prefix"),
            F.transform(f"{t}_norm_suffix", seconds).alias(f"{name}_expect"),
            F.transform(f"{t}_pred", seconds).alias(f"{name}_pred"),
        ]
    return rows.select(*out)


def remaining_time(records: DataFrame) -> Column:
    """Seconds until the end of the case: the predicted durations and waits."""
    times = ("tm",) if "tm_pred" in records.columns else ("dur", "wait")
    spent = total(F.col(f"{times[0]}_pred"))
    for t in times[1:]:
        spent = spent + total(F.col(f"{t}_pred"))
    return spent


def generated_log(
    prepared: Prepared,
    model: NgramModel,
    variant: str = RANDOM_CHOICE,
    seed: int = 0,
    run: int = 0,
    context: bool = False,
) -> DataFrame:
    """As many cases as the test part, starting with its first event."""
    num_cases, start_time = log_extent(prepared.test, prepared.schema.key).first()
    timed = _clock_states(prepared, model) if context else None
    return generate_log(
        model, num_cases, start_time, prepared.max_trace_size, prepared.activities,
        prepared.roles, prepared.scale_args, prepared.norm_method, prepared.schema,
        variant, seed, run, timed,
    )


def _clock_states(prepared: Prepared, model: NgramModel) -> DataFrame:
    columns = ["ac_index", "daytime", "weekday"]
    train = prepared.train
    if "daytime" not in train.columns:  # replaced by its scaled form
        train = train.withColumn("daytime", F.round(F.col("daytime_norm") * 86400))
    samples = ngram_samples(
        train, columns, model.n, prepared.ends, prepared.schema, prepared.hot
    )
    return timed_choices(samples, model)


# The sample builder of a task; a context model's samples carry its extra columns.
SAMPLERS = {"predict_next": next_event_samples, "pred_sfx": suffix_samples}


def task_samples(prepared: Prepared, task: str) -> DataFrame:
    """Next-event or prefix/suffix samples of the test part."""
    if task not in SAMPLERS:
        raise ValueError(task)
    columns = sample_columns(prepared.schema, prepared.spec.additional_columns)
    return SAMPLERS[task](prepared.test, columns, prepared.ends, prepared.schema)


def _score_next(prepared: Prepared, records: DataFrame) -> dict[str, DataFrame]:
    return {"accuracy": accuracy(records), "mae_next": mae_next(records)}


def _score_suffixes(prepared: Prepared, records: DataFrame) -> dict[str, DataFrame]:
    return {"similarity": suffix_similarity(records), "mae_suffix": mae_suffix(records)}


def _score_logs(prepared: Prepared, records: DataFrame) -> dict[str, DataFrame]:
    tiebreak = {c: F.col("pos") for c in prepared.schema.tiebreak}
    runs = records.withColumns(tiebreak)
    return {"log": compare_logs(prepared.test, runs, prepared.schema)}


EVALUATORS = {
    "predict_next": _score_next, "pred_sfx": _score_suffixes, "pred_log": _score_logs,
}


def evaluate(prepared: Prepared, task: str, records: DataFrame) -> dict[str, DataFrame]:
    """Score tables of a task's ``predictions``, by metric."""
    if task not in EVALUATORS:
        raise ValueError(task)
    return EVALUATORS[task](prepared, records)


def predictions(prepared, model, task: str, variant: str, rep: int = 1, seed: int = 0):
    """Predictions of a task for ``rep`` runs, with ``run_num``."""
    if task not in TASKS:
        raise ValueError(task)
    runs = [
        TASKS[task](prepared, model, variant=variant, seed=seed, run=r).withColumn("run_num", F.lit(r))
        for r in range(rep)
    ]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


TASKS = {
    "predict_next": next_event_records, "pred_sfx": suffix_records, "pred_log": generated_log,
}
