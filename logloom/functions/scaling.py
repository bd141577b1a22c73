"""Feature scaling: fit the arguments once, apply them as literals, invert.

Arguments are plain floats per feature, so applying a scaler is a projection.
A degenerate scale (max = min, std = 0) maps every value to 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.times import DAY_SECONDS
from logloom.schema import LogSchema

ScaleArgs = dict[str, float]


# method -> (aggregates that fit it, transform applied before fitting)
_RANGE = {"max_value": F.max, "min_value": F.min}
_FITS = {
    "lognorm": (_RANGE, F.log1p),
    "normal": (_RANGE, None),
    "standard": ({"mean": F.avg, "std": F.stddev_pop}, None),
    "max": ({"max_value": F.max}, None),
    "day_secs": ({}, None),
    None: ({}, None),
}


def _check(method) -> None:
    if method not in _FITS:
        raise ValueError(method)


def fit_scalers(log: DataFrame, methods: dict[str, str | None]) -> dict[str, ScaleArgs]:
    """Scale arguments of all features, from a single aggregation."""
    aggregates = []
    for feature, method in methods.items():
        _check(method)
        fits, before = _FITS[method]
        x = F.col(feature).cast("double")
        x = before(x) if before else x
        aggregates += [fit(x).alias(f"{feature}:{arg}") for arg, fit in fits.items()]
    found = log.agg(*aggregates).first().asDict() if aggregates else {}
    args = {}
    for feature, method in methods.items():
        fits, _ = _FITS[method]
        args[feature] = {a: _float(found[f"{feature}:{a}"]) for a in fits}
        if method == "day_secs":
            args[feature] = {"max_value": float(DAY_SECONDS)}
    return args


def _float(value) -> float:
    return 0.0 if value is None else float(value)


def fit_scaler(log: DataFrame, feature: str, method: str | None) -> ScaleArgs:
    return fit_scalers(log, {feature: method})[feature]


def scaled(x: Column, args: ScaleArgs, method: str | None) -> Column:
    """Scales an expression with fitted arguments."""
    _check(method)
    x = x.cast("double")
    if method is None:
        return x
    if method in ("max", "day_secs"):
        top = args["max_value"]
        return x / F.lit(top) if top > 0 else x * 0.0
    low, width = _affine(args, method)
    if width == 0:
        return x * 0.0
    return ((F.log1p(x) if method == "lognorm" else x) - F.lit(low)) / F.lit(width)


def scaled_values(x: np.ndarray, args: ScaleArgs, method: str | None) -> np.ndarray:
    """``scaled`` for an array of doubles in a task; NaN stands for NULL."""
    _check(method)
    if method is None:
        return x
    if method in ("max", "day_secs"):
        top = args["max_value"]
        return x / top if top > 0 else x * 0.0
    low, width = _affine(args, method)
    if width == 0:
        return x * 0.0
    if method == "lognorm":
        x = np.log1p(np.where(x > -1, x, np.nan))
    return (x - low) / width


def rescaled(x: Column, args: ScaleArgs, method: str | None) -> Column:
    """Inverts ``scaled``; ``max`` rounds half to even."""
    if method is None:
        return x
    if method == "max":
        return F.rint(x * F.lit(args["max_value"]))
    if method not in ("lognorm", "normal", "standard"):
        raise ValueError(method)
    low, width = _affine(args, method)
    value = x * F.lit(width) + F.lit(low)
    return F.expm1(value) if method == "lognorm" else value


def _affine(args: ScaleArgs, method: str) -> tuple[float, float]:
    if method == "standard":
        return args["mean"], args["std"]
    return args["min_value"], args["max_value"] - args["min_value"]


def apply_scaler(log, feature, args, method, replace=False) -> DataFrame:
    """Adds ``<feature>_norm``; ``replace`` drops the source column."""
    log = log.withColumn(f"{feature}_norm", scaled(F.col(feature), args, method))
    return log.drop(feature) if replace else log


def scale_feature(log, feature, method, replace=False) -> tuple[DataFrame, ScaleArgs]:
    args = fit_scaler(log, feature, method)
    return apply_scaler(log, feature, args, method, replace), args


def _basic(schema: LogSchema, norm_method, add_cols) -> dict:
    return {t: norm_method for t in schema.times}


def _inter(schema: LogSchema, norm_method, add_cols) -> dict:
    methods = _basic(schema, norm_method, add_cols)
    for column in add_cols:
        if column != "weekday":
            methods[column] = "day_secs" if column == "daytime" else norm_method
    return methods


PROFILES = {"basic": _basic, "inter": _inter}


def profile_methods(profile: str, schema: LogSchema, norm_method, add_cols=()) -> dict:
    """feature -> method of a scaler profile."""
    if profile not in PROFILES:
        raise ValueError(profile)
    return PROFILES[profile](schema, norm_method, tuple(add_cols))


def scale_features(
    log: DataFrame, profile: str, schema: LogSchema, norm_method, add_cols=(), args=None
) -> tuple[DataFrame, dict[str, ScaleArgs]]:
    """Scales the times and extra columns; extra columns are replaced.

    Pass the ``args`` fitted on the training part to scale a test part.
    """
    methods = profile_methods(profile, schema, norm_method, add_cols)
    args = args or fit_scalers(log, methods)
    columns = {f"{f}_norm": scaled(F.col(f), args[f], m) for f, m in methods.items()}
    log = log.withColumns(columns)
    return log.drop(*[f for f in methods if f not in schema.times]), args
