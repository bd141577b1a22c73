"""Evaluating model configurations side by side."""

from __future__ import annotations

import itertools
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.draws import draw_key
from logloom.functions.scaling import fit_scalers, scaled
from logloom.operators.ngram import NgramModel, context_key, fit_ngrams, likeliest, resolve
from logloom.runtime import pin
from logloom.schema import LogSchema

# Floor of a predicted probability, as in the usual cross-entropy.
EPSILON = 1e-7
OK, FAIL = "ok", "fail"


def config_grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """Every combination of the listed values; a handful of rows."""
    names = list(space)
    return spark.createDataFrame(list(itertools.product(*space.values())), names)


def sample_configs(configs: DataFrame, max_eval: int, seed: int) -> DataFrame:
    """``max_eval`` configurations without replacement, the same for a seed."""
    key = draw_key(*[F.col(c).cast("string") for c in configs.columns], str(seed))
    return configs.orderBy(key, *configs.columns).limit(max_eval)


def config_losses(
    train: DataFrame,
    valid: DataFrame,
    end: int,
    configs: DataFrame,
    schema: LogSchema = LogSchema(),
) -> DataFrame:
    """Trial table: validation loss of each (n_size, norm_method).

    ``train`` and ``valid`` are training samples over raw times, with windows of
    at least the largest ``n_size``. The longest contexts are counted once; a
    shorter ``n_size`` only shortens the context that is looked up, because
    support never grows with length. The loss is the cross-entropy of activity
    and role plus the mean absolute error of the scaled times.
    """
    wanted = [tuple(r) for r in configs.select("n_size", "norm_method").distinct().collect()]
    sizes = sorted({n for n, _ in wanted})
    methods = sorted({m for _, m in wanted})
    top = sizes[-1]
    train, valid = pin(train), pin(valid)
    model = fit_ngrams(train, top, end, schema.times)
    events = train.where(F.col("ac_index_next") != end)
    fits = {f"{t}_next": t for t in schema.times}
    args = {
        m: {
            t: a
            for t, a in zip(fits.values(), fit_scalers(events, {c: m for c in fits}).values())
        }
        for m in methods
    }
    rows = _looked_up(valid, model, sizes, schema)
    losses = _losses(rows, end, methods, args, schema)
    by_method = F.explode(
        F.array(*[
            F.struct(
                F.lit(m).alias("norm_method"),
                (F.col("ce") + F.col(f"mae_{m}")).alias("loss"),
                F.lit(json.dumps(args[m], sort_keys=True)).alias("scale_args"),
            )
            for m in methods
        ])
    )
    trials = losses.select("n_size", by_method.alias("t")).select("n_size", "t.*")
    trials = trials.join(F.broadcast(configs), ["n_size", "norm_method"])  # a handful of rows
    status = F.when(F.col("loss") > 0, OK).otherwise(FAIL)
    return trials.withColumns(
        {
            "sim_metric": F.lit("val_loss"),
            "status": status,
            "output": F.concat_ws("_", F.lit("trial"), F.col("n_size"), F.col("norm_method")),
        }
    )


def _looked_up(valid: DataFrame, model: NgramModel, sizes: list[int], schema: LogSchema):
    """Validation rows per n_size with p_ac, p_rl and the predicted times."""
    windows = pin(
        resolve(valid.select(F.col("ac_index_prefix").alias("window")), model).select(
            "window", F.explode(F.array(*[F.lit(n) for n in sizes])).alias("n_size"),
            F.filter(F.split("state", ","), lambda v: v != "").alias("state"),
        ).withColumn("k", F.least(F.size("state"), F.col("n_size"))).select(
            "window", "n_size",
            context_key(F.slice("state", F.size("state") - F.col("k") + 1, F.col("k"))).alias("ctx"),
        )
    )
    states = model.states.select("ctx", "ac", "rl", "total", likeliest("ac").alias("best"))
    choices = pin(windows.join(states, "ctx"))
    rows = valid.join(choices, valid["ac_index_prefix"] == choices["window"])

    def chance(listed, label):
        hits = F.filter(listed, lambda c: c["next"] == F.col(label))
        return F.coalesce(F.get(hits, F.lit(0))["n"], F.lit(0)) / F.col("total")

    return rows.select(
        "n_size", "ac_index_next", F.col("best.next").alias("ac_pred"),
        chance("ac", "ac_index_next").alias("p_ac"), chance("rl", "rl_index_next").alias("p_rl"),
        *[F.col(f"{t}_next") for t in schema.times],
        *[F.col(f"best.{t}").alias(f"{t}_pred") for t in schema.times],
    )


def _losses(rows, end, methods, args, schema):
    def cross_entropy(p):
        return F.avg(-F.log(F.greatest(F.col(p), F.lit(EPSILON))))

    def on_scale(column, code, t, m):
        """The end sentinel is 0 on every scale."""
        return F.when(F.col(code) == end, 0.0).otherwise(scaled(F.col(column), args[m][t], m))

    errors = []
    for m in methods:
        parts = [
            F.abs(on_scale(f"{t}_next", "ac_index_next", t, m) - on_scale(f"{t}_pred", "ac_pred", t, m))
            for t in schema.times
        ]
        errors.append(F.avg(sum(parts) / len(parts)).alias(f"mae_{m}"))
    ce = cross_entropy("p_ac") + cross_entropy("p_rl")
    return rows.groupBy("n_size").agg(ce.alias("ce"), *errors)


def successful(trials: DataFrame) -> DataFrame:
    return trials.where(F.col("status") == OK)


def best_trial(trials: DataFrame) -> DataFrame:
    """The successful trial with the lowest loss; ties go to the first output."""
    return successful(trials).orderBy("loss", "output").limit(1)


def matching_result(trials: DataFrame, results: DataFrame) -> DataFrame:
    """The stored result row of the best trial."""
    best = best_trial(trials).select("output")
    return results.join(best, "output").limit(1)
