"""From an event log with roles to a fitted model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.scaling import fit_scalers, profile_methods, scale_features
from logloom.operators.encode import CategoryIndex, build_indexes, encode
from logloom.operators.features import add_calculated_times, sample_columns
from logloom.operators.ngram import NgramModel, fit_ngrams
from logloom.operators.pairs import negative_samples
from logloom.operators.positions import hot_counted
from logloom.operators.samples import ngram_samples
from logloom.operators.split import TEST, TRAIN, case_spans, label_parts
from logloom.plans.specs import ModelSpec, model_spec
from logloom.runtime import pin
from logloom.schema import LogSchema


@dataclass(frozen=True)
class Prepared:
    """Timed, encoded and scaled parts of a log, and what they were made with."""

    train: DataFrame
    test: DataFrame
    activities: CategoryIndex
    roles: CategoryIndex
    scale_args: dict
    norm_method: str | None
    spec: ModelSpec
    schema: LogSchema
    max_trace_size: int
    hot: list[int]  # cases too long for one task

    @property
    def ends(self) -> dict[str, int]:
        return {"ac_index": self.activities.end, "rl_index": self.roles.end}

    @property
    def columns(self) -> list[str]:
        return ["ac_index", "rl_index", *self.schema.times_norm]


def prepare(
    log: DataFrame,
    model_type: str = "shared_cat",
    norm_method: str | None = "lognorm",
    schema: LogSchema = LogSchema(),
    size: float = 0.8,
    method: str = "auto",
) -> Prepared:
    """Indexes over the whole log; times scaled with the training part's range.

    ``log`` has a ``role`` (see ``operators.roles``). One table of case spans
    serves the split, the longest trace and the search for hot cases. The
    labelled log is pinned once, both parts and everything after them read it.
    """
    spec = model_spec(model_type)
    spans = pin(case_spans(log, schema))
    hot = hot_counted(spans, ["caseid"], "events")
    longest = spans.agg(F.coalesce(F.max("events"), F.lit(0))).first()[0]
    activities, roles = build_indexes(log, ["task", "role"])
    coded = encode(log, activities, "task", "ac_index")
    coded = encode(coded, roles, "role", "rl_index")
    timed = label_parts(add_calculated_times(coded, schema, hot), schema, size, method, spans)
    timed = pin(timed)
    train, test = timed.where(F.col("part") == TRAIN), timed.where(F.col("part") == TEST)
    extra = spec.additional_columns
    args = fit_scalers(train, profile_methods(spec.scaler, schema, norm_method, extra))
    train, _ = scale_features(train.drop("part"), spec.scaler, schema, norm_method, extra, args)
    test, _ = scale_features(test.drop("part"), spec.scaler, schema, norm_method, extra, args)
    return Prepared(
        train, test, activities, roles, args, norm_method, spec, schema, longest, hot
    )


def fit(prepared: Prepared, n: int = 5, min_support: int = 1) -> NgramModel:
    """Fits the n-gram model; its times are named after the scaled columns."""
    samples = training_samples(prepared, n)
    renamed = samples.withColumnsRenamed(
        {f"{t}_norm_next": f"{t}_next" for t in prepared.schema.times}
    )
    times = prepared.schema.times
    return fit_ngrams(pin(renamed), n, prepared.activities.end, times, min_support)


def training_samples(prepared: Prepared, n: int, columns: list[str] | None = None) -> DataFrame:
    columns = columns or prepared.columns
    return ngram_samples(
        prepared.train, columns, n, prepared.ends, prepared.schema, prepared.hot
    )


def _sequences(prepared: Prepared, n: int, seed: int) -> DataFrame:
    return training_samples(prepared, n)


def _sequences_with_context(prepared: Prepared, n: int, seed: int) -> DataFrame:
    columns = sample_columns(prepared.schema, prepared.spec.additional_columns)
    return training_samples(prepared, n, columns)


def _pair_classes(prepared: Prepared, n: int, seed: int) -> DataFrame:
    """Observed pairs are class 0 for the discriminator."""
    return negative_samples(
        prepared.train, prepared.activities.size, prepared.roles.size, seed,
        positive_label=0, schema=prepared.schema,
    )


VECTORIZERS = {
    "basic": _sequences, "inter": _sequences_with_context, "gan": _pair_classes,
}


def vectorize(prepared: Prepared, n: int, seed: int = 0) -> DataFrame:
    """The training table that the model's vectorizer builds."""
    return VECTORIZERS[prepared.spec.vectorizer](prepared, n, seed)
