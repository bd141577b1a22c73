"""Registered queries: configurations, learners and run tables."""

import uuid

from pyspark.sql import functions as F

from logloom.catalog import models as M
from logloom.catalog import sql as S
from logloom.catalog.common import INTERVAL, big, prepared, r6, text, user_roles
from logloom.functions.arrays import push
from logloom.operators import evaluate as E
from logloom.operators import learners as L
from logloom.operators import trials as X
from logloom.operators.features import filter_features
from logloom.operators.ngram import RANDOM_CHOICE
from logloom.operators.pairs import embedding_dimension
from logloom.operators.samples import ngram_samples, one_hot_labels
from logloom.plans.prediction import next_event_records, predictions
from logloom.plans.specs import model_spec
from logloom.plans.training import prepare, training_samples, vectorize
from logloom.runtime import pin, shared_folder
from logloom.sources import logs, runs
from logloom.sources.adapters import user_day_log

SPACE = {"n_size": [1, 2, 3], "norm_method": ["max", "lognorm"]}


def _trials(spark, folder):
    ready = prepare(user_roles(user_day_log(spark, folder)), norm_method=None)
    parts = [
        ngram_samples(x, ready.columns, 3, ready.ends, hot=ready.hot).withColumnsRenamed(
            {"dur_norm_next": "dur_next", "wait_norm_next": "wait_next"}
        )
        for x in (ready.train, ready.test)
    ]
    return X.config_losses(*parts, ready.activities.end, X.config_grid(spark, SPACE))


def config_eval(spark, folder):
    rows = _trials(spark, folder)
    return rows.select(big("n_size"), "norm_method", "status", F.round("loss", 5).alias("loss"))


def best_config(spark, folder):
    rows = X.best_trial(_trials(spark, folder))
    return rows.select(big("n_size"), "norm_method", F.round("loss", 5).alias("loss"))


def embedding_als(spark, folder):
    log, activities, roles, _ = prepared(spark, folder)
    ac, rl = L.embeddings(log, activities, roles)
    both = ac.withColumn("kind", F.lit("activity")).unionByName(rl.withColumn("kind", F.lit("role")))
    return both.select("kind", "idx", "name", F.size("vec").alias("dims"))


def embedding_factors(spark, folder):
    log, activities, roles, _ = prepared(spark, folder)
    ac, rl = L.factor_embeddings(log, activities, roles)
    both = ac.withColumn("kind", F.lit("activity")).unionByName(rl.withColumn("kind", F.lit("role")))
    rows = both.select("kind", big("idx"), "name", F.posexplode("vec").alias("place", "value"))
    value = F.round(F.col("value").cast("double"), 5) + F.lit(0.0)
    return rows.select("kind", "idx", "name", big("place"), value.alias("value"))


def mlp_next_activity(spark, folder):
    """Activity and role that two networks expect next."""
    spec = model_spec("shared_cat")
    ready = prepare(user_roles(user_day_log(spark, folder)), spec.name)
    columns = L.sample_columns_of(spec, ready.schema)
    train = pin(training_samples(ready, 3, columns))
    rows = ngram_samples(ready.test, columns, 3, ready.ends, hot=ready.hot)
    for head, classes in (("ac", ready.activities.size), ("rl", ready.roles.size)):
        model = L.fit_classifier(train, spec, head, 3, classes)
        rows = L.predict_head(model, rows, spec, 3).withColumnRenamed("prediction", f"{head}_pred")
        rows = rows.select(*[c for c in rows.columns if not c.endswith("_hot")]).drop("features", "rawPrediction", "probability")
    return rows.select(
        "caseid", big("cut"), big("ac_index_next", "expect"), big("ac_pred", "pred"),
        big("rl_index_next", "rl_expect"), big("rl_pred"),
    )


def gbt_next_times(spark, folder):
    """Scaled duration and waiting time that boosted trees expect next."""
    spec = model_spec("shared_cat_cx")
    ready = prepare(user_roles(user_day_log(spark, folder)), spec.name)
    columns = L.sample_columns_of(spec, ready.schema)
    rows = ngram_samples(ready.test, columns, 2, ready.ends, hot=ready.hot)
    models = L.fit_regressors(pin(training_samples(ready, 2, columns)), spec, 2)
    times = []
    for t, model in models.items():
        rows = L.predict_head(model, rows, spec, 2)
        rows = rows.select(*[c for c in rows.columns if not c.endswith("_hot")]).drop("features")
        times += [r6(f"{t}_next"), r6(f"{t}_pred")]
    return rows.select("caseid", big("cut"), *times)


def discriminator_pairs(spark, folder):
    """Training table of the discriminator: observed pairs are class 0."""
    ready = prepare(user_roles(user_day_log(spark, folder)), "simple_gan")
    rows = vectorize(ready, 3, seed=7)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(big("label"), "n")


def run_parameters(spark, folder):
    """Indexes and scale arguments, written as run metadata and read back."""
    ready = prepare(user_roles(user_day_log(spark, folder)), norm_method="max")
    path = f"{shared_folder(spark)}/runs/{uuid.uuid4().hex}"
    runs.write_parameters(
        path, {"norm_method": "max"}, False, ready.max_trace_size, ready.scale_args,
        ready.activities, ready.roles,
    )
    back = runs.read_parameters(spark, path)
    tables = [
        i.table.select(F.lit(kind).alias("kind"), big("idx"), "value")
        for kind, i in (("ac", back.activities), ("rl", back.roles))
    ]
    rows = tables[0].unionByName(tables[1])
    return rows.withColumns(
        {
            "max_trace_size": F.lit(back.max_trace_size).cast("bigint"),
            "dur_max": F.round(F.lit(back.scale_args["dur"]["max_value"]), 6),
        }
    )


def _path(spark, kind):
    return f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"


def predictions_roundtrip(spark, folder):
    """Next-event predictions of two runs, written by run and read back."""
    ready, model = M.trained(spark, folder)
    rows = predictions(ready, model, "predict_next", RANDOM_CHOICE, 2, M.SEED)
    rows = rows.select("run_num", "caseid", big("cut"), big("ac_pred"), big("rl_pred"))
    path = _path(spark, "predictions")
    runs.write_predictions(rows, path)
    kept = "run_num int, caseid string, cut bigint, ac_pred bigint, rl_pred bigint"
    back = runs.read_predictions(spark, path, kept)
    return back.select(big("run_num"), "caseid", "cut", "ac_pred", "rl_pred")


def trials_roundtrip(spark, folder):
    """Trials appended in two parts; the one that the best of them matches."""
    path = _path(spark, "trials")
    trials = pin(_trials(spark, folder))
    for method in ("max", "lognorm"):
        runs.append_trials(trials.where(F.col("norm_method") == method), path)
    stored = runs.read_trials(spark, path)
    best = X.matching_result(trials, stored.withColumn("found", F.lit(True)).select("output", "found"))
    rows = stored.join(best, "output", "left")
    return rows.select(
        big("n_size"), "norm_method", F.round("loss", 5).alias("loss"), "output",
        F.coalesce("found", F.lit(False)).alias("best"),
        F.round(F.col("scale_args")["dur"]["max_value"], 6).alias("dur_max"),
    )


def embedding_roundtrip(spark, folder):
    """A table of vectors by activity; rows whose name is not that of their number go."""
    log, activities, _, _ = prepared(spark, folder)
    counts = log.groupBy("ac_index").agg(F.count(F.lit(1)).cast("float").alias("n"))
    rows = activities.table.join(counts, F.col("idx") == F.col("ac_index"), "left")
    vec = F.array(F.coalesce("n", F.lit(0.0).cast("float")), F.col("idx").cast("float"))
    name = F.when(F.col("idx") == 2, "someone else").otherwise(F.concat(F.lit(" "), "value"))
    path = _path(spark, "embeddings")
    runs.write_embedding(rows.select("idx", name.alias("name"), vec.alias("vec")), path)
    back = runs.read_embedding(spark, path, activities)
    return back.select(big("idx"), "name", F.col("vec")[0].cast("bigint").alias("events"),
                       F.col("vec")[1].cast("bigint").alias("code"))


def one_hot_targets(spark, folder):
    """Samples with 0/1 arrays of the next activity and role as targets."""
    log, activities, roles, ends = prepared(spark, folder)
    rows = ngram_samples(log, ["ac_index", "rl_index"], 2, ends)
    rows = one_hot_labels(rows, {"ac_index": activities.size, "rl_index": roles.size})
    return rows.select("caseid", big("cut"), text("ac_index_prefix"), text("ac_index_next"), text("rl_index_next"))


def model_features(spark, folder):
    """The columns that a model uses, of a log with more."""
    log, _, _, _ = prepared(spark, folder)
    rows = filter_features(log.withColumn("cost", F.lit(1)), INTERVAL, ("weekday",))
    return rows.select(
        *[c for c in rows.columns if c not in ("start_timestamp", "end_timestamp", "event_key", "ac_index",
                                               "rl_index", "weekday", "dur", "wait")],
        big("ac_index"), big("rl_index"), big("weekday"), r6("dur"), r6("wait"), big("event_key", "event_id"),
    )


def described_scores(spark, folder):
    """The mean accuracy and the experiment's parameters, without bookkeeping."""
    ready, model = M.trained(spark, folder)
    mean = E.mean_metric(E.accuracy(next_event_records(ready, model)), "accuracy")
    params = {"n_size": M.N, "norm_method": "lognorm", "read_options": "x", "dim": "y", "is_single_exec": "z"}
    rows = E.describe(mean, params)
    return rows.select(r6("mean"), *[c for c in rows.columns if c != "mean"]).withColumn("n_size", big("n_size"))


def pushed_windows(spark, folder):
    """Windows of three activities slid by the activity that follows, and the embedding's size."""
    log, activities, roles, ends = prepared(spark, folder)
    rows = ngram_samples(log, ["ac_index"], 3, ends)
    size = embedding_dimension(activities.size, roles.size)
    pushed = push(F.col("ac_index_prefix"), F.col("ac_index_next"), 3)
    return rows.select("caseid", big("cut"), text(pushed, name="pushed"), F.lit(size).cast("bigint").alias("dim"))


def stale_columns(spark, folder):
    """Logs with leftovers of an exported frame: dropped if all are there, else kept."""
    out = []
    for stale in (("Unnamed: 0", "role"), ("role",)):
        path = _path(spark, "stale")
        log = user_day_log(spark, folder).withColumns({c: F.lit("old") for c in stale})
        logs.write_log(log, path)
        rows = logs.read_test_log(spark, path)
        kept = F.lit(",".join(c for c in rows.columns if c in ("Unnamed: 0", "role"))).alias("kept")
        out.append(rows.groupBy("task").agg(F.count(F.lit(1)).alias("events")).select("task", "events", kept))
    return out[0].unionByName(out[1])


_LOSS = f"""
lim AS (SELECT min(ln(1 + dur)) AS dlo, max(ln(1 + dur)) AS dhi, min(ln(1 + wait)) AS wlo,
    max(ln(1 + wait)) AS whi, max(dur) AS dmax, max(wait) AS wmax FROM tr),
sup AS (SELECT DISTINCT ctx FROM m1),
vs AS (SELECT n_size, ([0, 0, 0, 0] || a)[cut + 2 : cut + 4] AS win, (a || [ac_end])[cut + 1] AS nx,
    (r || [rl_end])[cut + 1] AS rnx, (d || [0.0])[cut + 1] AS dx, (w || [0.0])[cut + 1] AS wx
  FROM teq, nd, LATERAL (SELECT unnest(range(len + 1)) AS cut), (VALUES (1), (2), (3)) s(n_size)),
vk AS (SELECT *, CASE
    WHEN n_size >= 3 AND array_to_string(win, ',') IN (SELECT ctx FROM sup) THEN array_to_string(win, ',')
    WHEN n_size >= 2 AND array_to_string(win[2:3], ',') IN (SELECT ctx FROM sup) THEN array_to_string(win[2:3], ',')
    WHEN array_to_string(win[3:3], ',') IN (SELECT ctx FROM sup) THEN array_to_string(win[3:3], ',')
    ELSE '' END AS ctx FROM vs),
bst AS (SELECT m1.ctx, m1.nx, dm, wm, row_number() OVER (PARTITION BY m1.ctx ORDER BY n DESC, m1.nx) AS rn
  FROM m1 JOIN m2 ON m2.ctx = m1.ctx AND m2.nx = m1.nx WHERE head = 'ac'),
sc AS (SELECT n_size, -ln(greatest(coalesce(pa.n / pa.total, 0), 1e-7)) AS ca,
    -ln(greatest(coalesce(pr.n / pr.total, 0), 1e-7)) AS cr, vk.nx, dx, wx, bst.nx AS bx, dm, wm
  FROM vk LEFT JOIN m1 pa ON pa.head = 'ac' AND pa.ctx = vk.ctx AND pa.nx = vk.nx
    LEFT JOIN m1 pr ON pr.head = 'rl' AND pr.ctx = vk.ctx AND pr.nx = vk.rnx
    JOIN bst ON bst.ctx = vk.ctx AND bst.rn = 1),
er AS (SELECT n_size, ca, cr,
    (abs(CASE WHEN nx = ac_end THEN 0 ELSE dx / dmax END - CASE WHEN bx = ac_end THEN 0 ELSE dm / dmax END)
     + abs(CASE WHEN nx = ac_end THEN 0 ELSE wx / wmax END - CASE WHEN bx = ac_end THEN 0 ELSE wm / wmax END)) / 2 AS emax,
    (abs(CASE WHEN nx = ac_end THEN 0 ELSE (ln(1 + dx) - dlo) / (dhi - dlo) END
       - CASE WHEN bx = ac_end THEN 0 ELSE (ln(1 + dm) - dlo) / (dhi - dlo) END)
     + abs(CASE WHEN nx = ac_end THEN 0 ELSE (ln(1 + wx) - wlo) / (whi - wlo) END
       - CASE WHEN bx = ac_end THEN 0 ELSE (ln(1 + wm) - wlo) / (whi - wlo) END)) / 2 AS elog
  FROM sc, nd, lim),
tri AS (SELECT n_size, 'max' AS norm_method, avg(ca) + avg(cr) + avg(emax) AS loss FROM er GROUP BY n_size
  UNION ALL SELECT n_size, 'lognorm', avg(ca) + avg(cr) + avg(elog) FROM er GROUP BY n_size)
"""

def _factors_sql(dims: int, rounds: int) -> str:
    """Subspace iteration and Gram-Schmidt, step by step."""
    every = range(dims)
    sums = ", ".join(f"sum(x * v{k}) AS v{k}" for k in every)
    out = [f"""
co AS MATERIALIZED (SELECT ac, rl, ln(1 + count(*)) AS x FROM en GROUP BY ac, rl),
f0 AS MATERIALIZED (SELECT DISTINCT rl, {", ".join(f"cos({k}.0 * rl) AS v{k}" for k in every)} FROM co)"""]
    for i in range(1, rounds + 1):
        out.append(f"""
u{i} AS MATERIALIZED (SELECT ac, {sums} FROM co JOIN f{i - 1} USING (rl) GROUP BY ac),
w{i} AS MATERIALIZED (SELECT rl, {sums} FROM co JOIN u{i} USING (ac) GROUP BY rl)""")
        last = f"w{i}"
        for k in every:
            others = ", ".join(f"v{j}" for j in every if j != k)
            less = "".join(f" - v{j} * sum(v{j} * v{k}) OVER ()" for j in range(k))
            name = f"f{i}" if k == dims - 1 else f"g{i}_{k}"
            out.append(f"""
h{i}_{k} AS MATERIALIZED (SELECT rl, {others}, v{k}{less} AS v{k}, sum(v{k} * v{k}) OVER () AS q FROM {last}),
{name} AS MATERIALIZED (SELECT rl, {others}, CASE WHEN sum(v{k} * v{k}) OVER () > {L.DEPENDENT} * q
  THEN v{k} / sqrt(sum(v{k} * v{k}) OVER ()) ELSE 0 END AS v{k} FROM h{i}_{k})""")
            last = name
    roots = ", ".join(f"pow(sum(v{k} * v{k}), 0.25) AS s{k}" for k in every)
    out.append(f"""
ul AS MATERIALIZED (SELECT ac, {sums} FROM co JOIN f{rounds} USING (rl) GROUP BY ac),
sg AS MATERIALIZED (SELECT {roots} FROM ul),
vc AS (SELECT 'activity' AS kind, ac AS idx, [{", ".join(f"CASE WHEN s{k} > 0 THEN v{k} / s{k} ELSE 0 END" for k in every)}] AS vec
    FROM ul, sg
  UNION ALL SELECT 'role', rl, [{", ".join(f"v{k} * s{k}" for k in every)}] FROM f{rounds}, sg),
nm AS (SELECT 'activity' AS kind, idx, value FROM aci UNION ALL SELECT 'activity', 0, 'start'
  UNION ALL SELECT 'activity', ac_end, 'end' FROM nd
  UNION ALL SELECT 'role', idx, value FROM rli UNION ALL SELECT 'role', 0, 'start'
  UNION ALL SELECT 'role', rl_end, 'end' FROM nd)""")
    return ",".join(out)


QUERIES = {
    "config_eval": (
        config_eval,
        S.with_(M.MODEL, _LOSS, select=f"""
            SELECT CAST(n_size AS BIGINT) AS n_size, norm_method, 'ok' AS status,
              {S.rnd("loss", "loss", 5)} FROM tri"""),
    ),
    "best_config": (
        best_config,
        S.with_(M.MODEL, _LOSS, select=f"""
            SELECT CAST(n_size AS BIGINT) AS n_size, norm_method, {S.rnd("loss", "loss", 5)}
            FROM tri ORDER BY loss LIMIT 1"""),
    ),
    "embedding_als": (embedding_als, None),
    # the table of activities and roles has four dimensions at any scale
    "embedding_factors": (
        embedding_factors,
        S.with_(S.PREPARED, _factors_sql(4, L.FACTOR_ROUNDS), select="""
            SELECT kind, CAST(idx AS BIGINT) AS idx, value AS name, CAST(k AS BIGINT) AS place,
              round(CAST(CAST(coalesce(vec[k + 1], 0) AS FLOAT) AS DOUBLE), 5) + 0.0 AS value
            FROM nm LEFT JOIN vc USING (kind, idx), (SELECT unnest(range(4)) AS k)"""),
    ),
    "mlp_next_activity": (mlp_next_activity, None),
    "gbt_next_times": (gbt_next_times, None),
    "discriminator_pairs": (
        discriminator_pairs,
        S.with_(M.MODEL, select="""
            SELECT CAST(0 AS BIGINT) AS label, CAST(round(count(*) / 3) AS BIGINT) AS n FROM tr
            UNION ALL SELECT 1, 2 * CAST(round(count(*) / 3) AS BIGINT) FROM tr"""),
    ),
    "predictions_roundtrip": (
        predictions_roundtrip,
        S.with_(M.STATES, M._RESOLVED, select=" UNION ALL ".join(f"""
            SELECT CAST({run} AS BIGINT) AS run_num, caseid, cut, c.nx AS ac_pred, q.nx AS rl_pred FROM rs
            JOIN ch c ON {M._drawn("c", "ac", "ac", ["caseid", "cut"], run=f"'{M.SEED}-{run}'")}
            JOIN ch q ON {M._drawn("q", "rl", "rl", ["caseid", "cut"], run=f"'{M.SEED}-{run}'")}
            WHERE cut < len""" for run in range(2))),
    ),
    "trials_roundtrip": (
        trials_roundtrip,
        S.with_(M.MODEL, _LOSS, select=f"""
            SELECT CAST(n_size AS BIGINT) AS n_size, norm_method, {S.rnd("loss", "loss", 5)},
              'trial_' || n_size || '_' || norm_method AS output,
              row_number() OVER (ORDER BY loss, 'trial_' || n_size || '_' || norm_method) = 1 AS best,
              round(CASE norm_method WHEN 'max' THEN dmax ELSE dhi END, 6) AS dur_max
            FROM tri, lim"""),
    ),
    "embedding_roundtrip": (
        embedding_roundtrip,
        S.with_(S.PREPARED, select="""
            SELECT idx, value AS name, (SELECT count(*) FROM en WHERE ac = idx) AS events, idx AS code
            FROM (SELECT value, idx FROM aci UNION ALL SELECT 'start', 0 UNION ALL SELECT 'end', ac_end FROM nd)
            WHERE idx <> 2"""),
    ),
    "one_hot_targets": (
        one_hot_targets,
        S.with_(S.PREPARED, """
tq AS (SELECT caseid, any_value(len) AS len, [0, 0] || list(ac ORDER BY pos) || [any_value(ac_end)] AS a,
    list(rl ORDER BY pos) || [any_value(rl_end)] AS r FROM en, nd GROUP BY caseid)
""", select="""
            SELECT caseid, cut, array_to_string(a[cut + 1 : cut + 2], ',') AS ac_index_prefix,
              array_to_string(list_transform(range(ac_end + 1), lambda i: CAST(i = a[cut + 3] AS INT)), ',') AS ac_index_next,
              array_to_string(list_transform(range(rl_end + 1), lambda i: CAST(i = r[cut + 1] AS INT)), ',') AS rl_index_next
            FROM tq, nd, LATERAL (SELECT unnest(range(len + 1)) AS cut)"""),
    ),
    "model_features": (
        model_features,
        S.with_(S.PREPARED, select=f"""
            SELECT caseid, task, usr AS "user", role, ac AS ac_index, rl AS rl_index, weekday,
              {S.r6("dur")}, {S.r6("wait")}, o1 AS event_id FROM en"""),
    ),
    "described_scores": (
        described_scores,
        S.with_(M.STATES, M._RESOLVED, select=f"""
            SELECT {S.r6("(avg(CAST(a[cut + 1] = c.nx AS INT)) + avg(CAST(r[cut + 1] = q.nx AS INT))) / 2", "mean")},
              CAST({M.N} AS BIGINT) AS n_size, 'lognorm' AS norm_method
            FROM rs JOIN ch c ON c.head = 'ac' AND c.ctx = rs.ctx AND c.rn = 1
              JOIN ch q ON q.head = 'rl' AND q.ctx = rs.ctx AND q.rn = 1 WHERE cut < len"""),
    ),
    "pushed_windows": (
        pushed_windows,
        S.with_(S.PREPARED, """
tq AS (SELECT caseid, any_value(len) AS len, [0, 0, 0] || list(ac ORDER BY pos) || [any_value(ac_end)] AS a
  FROM en, nd GROUP BY caseid)
""", select="""
            SELECT caseid, cut, array_to_string(a[cut + 2 : cut + 4], ',') AS pushed,
              CAST(ceil(pow((ac_end + 1) * (rl_end + 1), 0.25)) AS BIGINT) AS dim
            FROM tq, nd, LATERAL (SELECT unnest(range(len + 1)) AS cut)"""),
    ),
    "stale_columns": (
        stale_columns,
        S.with_(S.USER_DAY_LOG, select="""
            SELECT task, count(*) AS events, kept FROM lg, (VALUES (''), ('role')) v(kept) GROUP BY task, kept"""),
    ),
    "run_parameters": (
        run_parameters,
        S.with_(M.MODEL, select=f"""
            SELECT kind, idx, value, mx AS max_trace_size,
              (SELECT round(max(dur), 6) FROM tr) AS dur_max FROM mts, (
                SELECT 'ac' AS kind, idx, value FROM aci UNION ALL SELECT 'ac', 0, 'start'
                UNION ALL SELECT 'ac', ac_end, 'end' FROM nd
                UNION ALL SELECT 'rl', idx, value FROM rli UNION ALL SELECT 'rl', 0, 'start'
                UNION ALL SELECT 'rl', rl_end, 'end' FROM nd)"""),
    ),
}
