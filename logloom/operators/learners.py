"""Distributed learners over the sample tables: per-head models, embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.operators.encode import CategoryIndex
from logloom.operators.pairs import embedding_dimension, observed_pairs
from logloom.plans.specs import ACTIVITIES, CONTEXT, ROLES, TIMES, ModelSpec
from logloom.runtime import pin
from logloom.schema import LogSchema

# Passes of the factorisation over the co-occurrence table.
FACTOR_ROUNDS = 6
# A vector is dependent on those before it below this share of its squared length.
DEPENDENT = 1e-10

HEADS = {"ac": "ac_index_next", "rl": "rl_index_next"}


def _steps(group: str, schema: LogSchema) -> tuple[list[str], list[str]]:
    """(categorical, numeric) sample columns of a feature group."""
    return {
        ACTIVITIES: (["ac_index"], []),
        ROLES: (["rl_index"], []),
        TIMES: ([], schema.times_norm),
        CONTEXT: (["weekday"], ["daytime_norm"]),
    }[group]


def spread(samples: DataFrame, columns: list[str], n: int) -> DataFrame:
    """One column per step of the prefix: ``<column>_1`` .. ``<column>_n``."""
    steps = {
        f"{c}_{i}": F.element_at(f"{c}_prefix", i) for c in columns for i in range(1, n + 1)
    }
    return samples.withColumns(steps)


def _features(groups, n: int, schema: LogSchema) -> tuple[list, list[str]]:
    """Stages that turn the spread columns of ``groups`` into ``features``."""
    categorical, numeric = [], []
    for group in groups:
        some, more = _steps(group, schema)
        categorical += [f"{c}_{i}" for c in some for i in range(1, n + 1)]
        numeric += [f"{c}_{i}" for c in more for i in range(1, n + 1)]
    stages, inputs = [], list(numeric)
    if categorical:
        hot = [f"{c}_hot" for c in categorical]
        stages.append(OneHotEncoder(inputCols=categorical, outputCols=hot, handleInvalid="keep"))
        inputs = hot + inputs
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    return stages, inputs


def sample_columns_of(spec: ModelSpec, schema: LogSchema) -> list[str]:
    columns = ["ac_index", "rl_index", *schema.times_norm]
    return columns + (["weekday", "daytime_norm"] if spec.additional_columns else [])


def fit_classifier(
    samples: DataFrame, spec: ModelSpec, head: str, n: int, classes: int,
    schema: LogSchema = LogSchema(), hidden: int = 50, max_iter: int = 50, seed: int = 1,
) -> PipelineModel:
    """Network for the next activity (``ac``) or role (``rl``), routed by ``spec``."""
    stages, _ = _features(spec.heads[head], n, schema)
    spread_rows = spread(samples, sample_columns_of(spec, schema), n)
    encoder = Pipeline(stages=stages).fit(spread_rows)
    rows = encoder.transform(spread_rows).select("features", F.col(HEADS[head]).alias("label"))
    inputs = rows.schema["features"].metadata["ml_attr"]["num_attrs"]
    network = MultilayerPerceptronClassifier(
        layers=[inputs, hidden, classes], maxIter=max_iter, seed=seed
    )
    return PipelineModel(stages=[*encoder.stages, network.fit(rows)])


def fit_regressors(
    samples: DataFrame, spec: ModelSpec, n: int, schema: LogSchema = LogSchema(), **options
) -> dict[str, PipelineModel]:
    """Boosted trees for each scaled time, routed by ``spec``."""
    stages, _ = _features(spec.heads["time"], n, schema)
    rows = spread(samples, sample_columns_of(spec, schema), n)
    models = {}
    for t in schema.times_norm:
        trees = GBTRegressor(labelCol=f"{t}_next", predictionCol=f"{t}_pred", **options)
        models[t] = Pipeline(stages=[*stages, trees]).fit(rows)
    return models


def predict_head(model: PipelineModel, samples: DataFrame, spec, n: int, schema=LogSchema()):
    return model.transform(spread(samples, sample_columns_of(spec, schema), n))


def embeddings(
    log: DataFrame, activities: CategoryIndex, roles: CategoryIndex, seed: int = 0
) -> tuple[DataFrame, DataFrame]:
    """(idx, name, vec) of activities and of roles, from their co-occurrence."""
    counts = observed_pairs(log).withColumn("n", F.col("n").cast("float"))
    dims = embedding_dimension(activities.size, roles.size)
    als = ALS(
        userCol="ac_index", itemCol="rl_index", ratingCol="n", implicitPrefs=True,
        rank=dims, seed=seed,
    )
    model = als.fit(counts)
    return _named(model.userFactors, activities, dims), _named(model.itemFactors, roles, dims)


def factor_embeddings(
    log: DataFrame, activities: CategoryIndex, roles: CategoryIndex, rounds: int = FACTOR_ROUNDS
) -> tuple[DataFrame, DataFrame]:
    """(idx, name, vec) of activities and of roles, by a truncated factorisation.

    ``ln(1 + n)`` of the co-occurrences is projected onto the roles' leading subspace; the
    dot product of an activity and a role is their projected entry. Subspace iteration
    starts at cosines of the role's number and keeps the signs of the start, so values are
    reproducible; vectors beyond the rank of the table are zero. A pass is two grouped
    products, and only matrices of the embedding's dimension reach the driver.
    """
    dims = embedding_dimension(activities.size, roles.size)
    entries = observed_pairs(log).withColumn("x", F.log1p("n")).select("ac_index", "rl_index", "x")
    entries = pin(entries)
    start = F.array(*[F.cos(F.lit(float(k)) * F.col("rl_index")) for k in range(dims)])
    factors = pin(entries.select("rl_index").distinct().select("rl_index", start.alias("vec")))
    for _ in range(rounds):
        sums = _product(entries, factors, "rl_index", "ac_index", dims)
        factors = pin(_product(entries, sums, "ac_index", "rl_index", dims))
        # twice, as the first pass loses digits if the vectors are nearly dependent
        for _ in range(2):
            factors = pin(_times(factors, _orthogonal(_gram(factors, dims))))
    sums = pin(_product(entries, factors, "rl_index", "ac_index", dims))
    root = np.sqrt(np.sqrt(np.diag(_gram(sums, dims))))
    inverse = np.divide(1.0, root, out=np.zeros(dims), where=root > 0)
    activity = _times(sums, np.diag(inverse)).withColumnRenamed("ac_index", "id")
    role = _times(factors, np.diag(root)).withColumnRenamed("rl_index", "id")
    return tuple(
        _named(f.select("id", F.col("vec").cast("array<float>").alias("features")), index, dims)
        for f, index in ((activity, activities), (role, roles))
    )


def _product(entries: DataFrame, factors: DataFrame, over: str, by: str, dims: int) -> DataFrame:
    """(by, vec): the entries of each ``by`` times the vectors they meet at ``over``."""
    sums = [F.sum(F.col("x") * F.get("vec", F.lit(k))) for k in range(dims)]
    return entries.join(factors, over).groupBy(by).agg(F.array(*sums).alias("vec"))


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _gram(factors: DataFrame, dims: int) -> np.ndarray:
    """Dot products of the columns, summed by task first."""

    def run(batches):
        gram = np.zeros((dims, dims))
        for batch in batches:
            rows = _matrix(batch.column(0), dims)
            gram += rows.T @ rows
        cells = pa.array(np.arange(dims * dims, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([cells, pa.array(gram.ravel())], ["cell", "dot"])

    parts = factors.select("vec").mapInArrow(run, "cell int, dot double")
    gram = np.zeros(dims * dims)
    for row in parts.groupBy("cell").agg(F.sum("dot").alias("dot")).collect():
        gram[row["cell"]] = row["dot"]
    return gram.reshape(dims, dims)


def _orthogonal(gram: np.ndarray) -> np.ndarray:
    """The upper triangle that makes columns with these dot products orthonormal, in order."""
    out = np.zeros_like(gram)
    for k in range(len(gram)):
        c = np.zeros(len(gram))
        c[k] = 1
        c -= out @ (out.T @ gram[:, k])
        length = c @ gram @ c
        if length > DEPENDENT * gram[k, k]:
            out[:, k] = c / np.sqrt(length)
    return out


def _times(factors: DataFrame, matrix: np.ndarray) -> DataFrame:
    key = factors.columns[0]

    def run(batches):
        for batch in batches:
            rows = _matrix(batch.column(1), len(matrix)) @ matrix
            ends = np.arange(len(rows) + 1, dtype=np.int32) * len(matrix)
            vec = pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vec], [key, "vec"])

    return factors.mapInArrow(run, f"{key} int, vec array<double>")


def _named(factors: DataFrame, index: CategoryIndex, dims: int) -> DataFrame:
    """A row for every code; codes outside the log, as the sentinels, are zero."""
    factors = factors.select(F.col("id").alias("idx"), F.col("features").alias("vec"))
    named = index.table.select("idx", F.col("value").alias("name")).join(factors, "idx", "left")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return named.select("idx", "name", F.coalesce("vec", zeros).alias("vec"))
