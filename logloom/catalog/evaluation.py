"""Registered queries: scores of predictions and generated logs."""

import re

from pyspark.sql import functions as F

from logloom.catalog import models as M
from logloom.catalog import sql as S
from logloom.catalog.common import INTERVAL, big, r6, user_roles
from logloom.operators import evaluate as E
from logloom.operators.occupancy import pool_occupancy
from logloom.operators.split import split_timeline
from logloom.operators.ngram import RANDOM_CHOICE
from logloom.plans.prediction import next_event_records, predictions, suffix_records
from logloom.sources.adapters import shipment_log, user_day_log, user_log


def _r4(column):
    return (F.round(column, 4) + F.lit(0.0)).alias(column)


def accuracy_next(spark, folder):
    ready, model = M.trained(spark, folder)
    return E.accuracy(next_event_records(ready, model)).select("feature", r6("accuracy"))


def mae_next(spark, folder):
    ready, model = M.trained(spark, folder)
    return E.mae_next(next_event_records(ready, model)).select("feature", _r4("mae"))


def suffix_similarity(spark, folder):
    ready, model = M.trained(spark, folder)
    scores = E.suffix_similarity(suffix_records(ready, model))
    return scores.select("feature", big("pref_size"), r6("mean"))


def mae_suffix(spark, folder):
    ready, model = M.trained(spark, folder)
    scores = E.mae_suffix(suffix_records(ready, model))
    return scores.select("feature", big("pref_size"), _r4("mean"))


def case_cycle_times(spark, folder):
    return E.cycle_times(shipment_log(spark, folder))


def _halves(spark, folder):
    """Two logs to compare: the cases before and after a cut in time."""
    return split_timeline(user_day_log(spark, folder), INTERVAL, 0.5, "trace")


def _compare(metric):
    def query(spark, folder):
        return E.METRICS[metric](*_halves(spark, folder)).select(_r4("sim_val"))

    return query


RUNS = 3


def log_metrics(spark, folder):
    """All metrics of repeated generated logs, as a metric table."""
    ready, model = M.trained(spark, folder)
    runs = predictions(ready, model, "pred_log", RANDOM_CHOICE, RUNS, M.SEED)
    table = E.compare_logs(ready.test, runs.withColumn("event_key", F.col("pos")))
    return table.select(big("run_num"), "metric", _r4("sim_val"))


def occupancy(spark, folder):
    log = user_roles(user_log(spark, folder))
    pools = log.groupBy("role").agg(F.countDistinct("user").alias("users"))
    rows = pool_occupancy(log, pools)
    return rows.select(
        big("event_key", "event_id"), "role", big("open_events"), big("role_busy"), r6("role_share")
    )


# Activity codes as single characters, for the built-in edit distance.
_SIMILARITY = """
pe AS (SELECT caseid, cut + 1 AS pref_size, id, a, r, d, w, cut, len FROM tes JOIN
    (SELECT caseid || '|' || cut AS id, caseid AS c2, cut AS k2 FROM tes) x ON x.c2 = caseid AND x.k2 = cut),
pr AS (SELECT id, string_agg(chr(CAST(65 + nx AS INT)), '' ORDER BY step) AS ac,
    string_agg(chr(CAST(65 + rnx AS INT)), '' ORDER BY step) AS rl, sum(dm) AS dsum, sum(wm) AS wsum
  FROM wk WHERE step > 0 GROUP BY id),
ex AS (SELECT id, pref_size,
    array_to_string(list_transform((a || [ac_end])[cut + 1 : len + 1], lambda x: chr(CAST(65 + x AS INT))), '') AS ac,
    array_to_string(list_transform((r || [rl_end])[cut + 1 : len + 1], lambda x: chr(CAST(65 + x AS INT))), '') AS rl,
    list_sum((d || [dmin])[cut + 1 : len + 1]) AS dsum, list_sum((w || [wmin])[cut + 1 : len + 1]) AS wsum
  FROM pe, nd, lows)
"""


def _sim(a, b):
    return f"1 - damerau_levenshtein({a}, {b}) / greatest(length({a}), length({b}))"


_PAIR = """
{log},
sp AS (SELECT caseid, min(k_us) AS f FROM lg GROUP BY caseid),
pt AS (SELECT caseid, row_number() OVER (ORDER BY f, caseid) <= ceil(0.5 * count(*) OVER ()) AS first FROM sp),
lgA AS (SELECT lg.* FROM lg JOIN pt USING (caseid) WHERE first),
lgB AS (SELECT lg.* FROM lg JOIN pt USING (caseid) WHERE NOT first)
"""
PAIR = _PAIR.format(log=S.USER_DAY_LOG)


def _cycles(side, src):
    return (
        f"cy{side} AS (SELECT caseid, max(e_us) - min(k_us) AS c FROM {src} GROUP BY caseid),"
        f" rk{side} AS (SELECT c, row_number() OVER (ORDER BY c) AS rn FROM cy{side})"
    )


CYCLES = _cycles("A", "lgA") + ",\n" + _cycles("B", "lgB")
_EMD = """
hi AS (SELECT isodow(make_timestamp(k_us)) AS wd, (k_us // 3600000000) % 24 AS h,
    1.0 / (SELECT count(*) FROM lgA) AS s FROM lgA
  UNION ALL SELECT isodow(make_timestamp(k_us)), (k_us // 3600000000) % 24,
    -1.0 / (SELECT count(*) FROM lgB) FROM lgB
  UNION ALL SELECT i // 24 + 1, i % 24, 0 FROM range(168) t(i)),
emd AS (SELECT avg(day) AS sim_val FROM (SELECT wd, sum(abs(moved)) AS day FROM (
    SELECT wd, sum(sum(CAST(s AS DOUBLE))) OVER (PARTITION BY wd ORDER BY h) AS moved
    FROM hi GROUP BY wd, h) GROUP BY wd))
"""
_LOG_MAE = "SELECT abs((SELECT avg(c) FROM cyA) - (SELECT avg(c) FROM cyB)) / 1e6 AS sim_val"
_MAE = "SELECT avg(abs(rkA.c - rkB.c)) / 1e6 AS sim_val FROM rkA JOIN rkB USING (rn)"


def _variants(side):
    return f"""
seq{side} AS (SELECT caseid, count(*) AS size, string_agg(task, chr(31) ORDER BY {S.ORD}) AS key,
    string_agg(chr(CAST(65 + idx AS INT)), '' ORDER BY {S.ORD}) AS s
  FROM lg{side} JOIN tix USING (task) GROUP BY caseid),
va{side} AS (SELECT size, key, s, count(*) AS n FROM seq{side} GROUP BY 1, 2, 3)"""


# Cases of equal sequences first; the rest expanded to cases and paired by rank.
DL = f"""
tix AS (SELECT task, row_number() OVER (ORDER BY task) AS idx FROM
  (SELECT task FROM lgA UNION SELECT task FROM lgB)),
{_variants("A")},
{_variants("B")},
same AS (SELECT coalesce(sum(least(vaA.n, vaB.n)), 0) AS m FROM vaA JOIN vaB USING (key)),
leftA AS (SELECT vaA.*, vaA.n - coalesce(vaB.n, 0) AS rest FROM vaA LEFT JOIN vaB USING (key)),
leftB AS (SELECT vaB.*, vaB.n - coalesce(vaA.n, 0) AS rest FROM vaB LEFT JOIN vaA USING (key)),
oneA AS (SELECT s, row_number() OVER (ORDER BY size, key) AS rn FROM leftA, LATERAL (SELECT unnest(range(rest))) WHERE rest > 0),
oneB AS (SELECT s, row_number() OVER (ORDER BY size, key) AS rn FROM leftB, LATERAL (SELECT unnest(range(rest))) WHERE rest > 0),
dl AS (SELECT (coalesce(sum({_sim("oneA.s", "oneB.s")}), 0) + (SELECT m FROM same))
    / (SELECT greatest((SELECT count(*) FROM seqA), (SELECT count(*) FROM seqB))) AS sim_val
  FROM oneA JOIN oneB USING (rn))
"""
# Cases ranked by (length, sequence, cycle time, case) and paired; the whole table of each
# pair row by row, a row as a list that grows cell by cell.
TSD = f"""
fx AS (SELECT side, caseid, task, {S.ORD}, (e_us - s_us) / 1e6 AS dur, e_us,
    greatest(coalesce(s_us - lag(e_us) OVER w, 0), 0) / 1e6 AS wait
  FROM (SELECT 1 AS side, caseid, task, s_us, e_us, {S.ORD} FROM lgA
    UNION ALL SELECT 2, caseid, task, s_us, e_us, {S.ORD} FROM lgB)
  WINDOW w AS (PARTITION BY side, caseid ORDER BY {S.ORD})),
tp AS (SELECT max(dur) AS dmax, max(wait) AS wmax FROM fx),
sq AS (SELECT side, caseid, count(*) AS size, string_agg(task, chr(31) ORDER BY {S.ORD}) AS key,
    max(e_us) - min(k_us) AS c, list(task ORDER BY {S.ORD}) AS t,
    list(coalesce(dur / nullif(dmax, 0), 0) ORDER BY {S.ORD}) AS d,
    list(coalesce(wait / nullif(wmax, 0), 0) ORDER BY {S.ORD}) AS w
  FROM fx, tp GROUP BY side, caseid),
rk AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY size, key, c, caseid) AS rn FROM sq),
cell AS (SELECT a.rn, a.t AS ta, a.d AS da, a.w AS wa, b.t AS tb, b.d AS db, b.w AS wb
  FROM rk a JOIN rk b ON a.rn = b.rn AND a.side = 1 AND b.side = 2),
dp AS (
  SELECT *, 0 AS i, [list_transform(range(len(tb) + 1), lambda j: CAST(j AS DOUBLE))] AS m FROM cell
  UNION ALL
  SELECT rn, ta, da, wa, tb, db, wb, i + 1, list_append(m, list_reduce(
      list_prepend([CAST(i + 1 AS DOUBLE)], list_transform(range(1, len(tb) + 1), lambda j: [CAST(j AS DOUBLE)])),
      lambda row, x: list_append(row, least(
        m[i + 1][CAST(x[1] AS INT)] + CASE WHEN ta[i + 1] = tb[CAST(x[1] AS INT)]
          THEN (abs(da[i + 1] - db[CAST(x[1] AS INT)]) + abs(wa[i + 1] - wb[CAST(x[1] AS INT)])) / 2 ELSE 1 END,
        m[i + 1][CAST(x[1] AS INT) + 1] + 1,
        row[CAST(x[1] AS INT)] + 1,
        coalesce(m[list_max(list_filter(range(1, i + 1), lambda k: ta[k] = tb[CAST(x[1] AS INT)]))]
            [list_max(list_filter(range(1, CAST(x[1] AS INT)), lambda l: tb[l] = ta[i + 1]))]
          + i - list_max(list_filter(range(1, i + 1), lambda k: ta[k] = tb[CAST(x[1] AS INT)]))
          + x[1] - list_max(list_filter(range(1, CAST(x[1] AS INT)), lambda l: tb[l] = ta[i + 1])), 1e30)))))
  FROM dp WHERE i < len(ta)),
tsd AS (SELECT sum(1 - m[len(ta) + 1][len(tb) + 1] / greatest(len(ta), len(tb)))
    / (SELECT max(rn) FROM rk) AS sim_val
  FROM dp WHERE i = len(ta))
"""
# Walks of all runs at once: the case's id is behind the run's number.
_ALL_RUNS = f"""
w0 AS (SELECT r || ':' || id AS id, win FROM (
    SELECT 'Case' || lpad(CAST(i AS VARCHAR), CAST(length(CAST(nc AS VARCHAR)) AS INT), '0') AS id, [0, 0, 0] AS win
    FROM (SELECT count(DISTINCT caseid) AS nc FROM te), LATERAL (SELECT unnest(range(nc)) AS i)), range({RUNS}) t(r))
"""
_OF_RUN = "split_part(h.id, ':', 2)", f"'{M.SEED}-' || split_part(h.id, ':', 1)"
_GENERATED_PAIR = """
lgA AS (SELECT caseid, task, k_us, s_us, e_us, o1, o2, o3 FROM te),
lgB AS (SELECT caseid, task, e_us - d AS k_us, e_us - d AS s_us, e_us, pos AS o1, 0 AS o2, 0 AS o3 FROM gl
  WHERE caseid LIKE '{run}:%')
"""


def _runs_sql() -> str:
    """The clauses of every metric once for each run, with names of their own."""
    body = [_GENERATED_PAIR, CYCLES, DL, _EMD, TSD]
    names = sorted({m for part in body for m in re.findall(r"\b(\w+) AS \(\s*SELECT", part)})
    clauses, rows = [], []
    values = {"dl": "SELECT sim_val FROM dl", "day_hour_emd": "SELECT sim_val FROM emd",
              "log_mae": _LOG_MAE, "mae": _MAE, "tsd": "SELECT sim_val FROM tsd"}
    for run in range(RUNS):
        own = re.compile(rf"\b({'|'.join(names)})\b(?!')")
        renamed = lambda sql: own.sub(lambda m: f"{m[1]}_{run}", sql.replace("{run}", str(run)))  # noqa: B023, E731
        clauses += [renamed(part) for part in body]
        rows += [f"SELECT CAST({run} AS BIGINT) AS run_num, '{m}' AS metric, sim_val FROM ({renamed(v)})" for m, v in values.items()]
    rounded = S.rnd("sim_val", "sim_val", 4)
    return S.with_(
        "RECURSIVE " + M.STATES, _ALL_RUNS, M.walk_sql("w0", True, *_OF_RUN), M.GENERATED, *clauses,
        select=f"SELECT run_num, metric, {rounded} FROM ({' UNION ALL '.join(rows)})",
    )


def _walked(*clauses, select):
    return S.with_(
        "RECURSIVE " + M.STATES, M._PER_CUT, M.walk_sql("w0", False), *clauses, select=select
    )


def _scored(pair, select):
    return S.with_(pair, CYCLES, select=f"SELECT {S.rnd('sim_val', 'sim_val', 4)} FROM ({select})")


_NEXT = f"""
pn AS (SELECT CAST(a[cut + 1] = c.nx AS INT) AS ac, CAST(r[cut + 1] = q.nx AS INT) AS rl,
    abs(d[cut + 1] - c.dm) AS dur, abs(w[cut + 1] - c.wm) AS wait
  FROM rs JOIN ch c ON c.head = 'ac' AND c.ctx = rs.ctx AND c.rn = 1
    JOIN ch q ON q.head = 'rl' AND q.ctx = rs.ctx AND q.rn = 1 WHERE cut < len)
"""


def _each(columns, digits, value, source, by=""):
    group = f" GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT '{name}' AS feature, {lead}{S.rnd(f'avg({x})', value, digits)} FROM {source}{group}"
        for name, x in columns.items()
    )


_SUFFIXES = "ex JOIN pr USING (id)"
QUERIES = {
    "accuracy_next": (
        accuracy_next,
        S.with_(M.STATES, M._RESOLVED, _NEXT, select=_each({"ac": "ac", "rl": "rl"}, 6, "accuracy", "pn")),
    ),
    "mae_next": (
        mae_next,
        S.with_(M.STATES, M._RESOLVED, _NEXT, select=_each({"dur": "dur", "wait": "wait"}, 4, "mae", "pn")),
    ),
    "suffix_similarity": (
        suffix_similarity,
        _walked(_SIMILARITY, select=_each(
            {f: _sim(f"pr.{f}", f"ex.{f}") for f in ("ac", "rl")}, 6, "mean", _SUFFIXES, "pref_size")),
    ),
    "mae_suffix": (
        mae_suffix,
        _walked(_SIMILARITY, select=_each(
            {"dur": "abs(ex.dsum - pr.dsum)", "wait": "abs(ex.wsum - pr.wsum)"}, 4, "mean",
            _SUFFIXES, "pref_size")),
    ),
    "cycle_times": (
        case_cycle_times,
        S.with_(S.SHIPMENT_LOG, select="""
            SELECT caseid, max(e_us) - min(k_us) AS cycle_us FROM lg GROUP BY caseid"""),
    ),
    "log_dl": (
        _compare("dl"),
        S.with_(PAIR, DL, select=f"SELECT {S.rnd('sim_val', 'sim_val', 4)} FROM dl"),
    ),
    "log_tsd": (
        _compare("tsd"),
        S.with_("RECURSIVE " + PAIR, TSD, select=f"SELECT {S.rnd('sim_val', 'sim_val', 4)} FROM tsd"),
    ),
    "log_mae": (_compare("log_mae"), _scored(PAIR, _LOG_MAE)),
    "cycle_mae": (_compare("mae"), _scored(PAIR, _MAE)),
    "day_hour_emd": (
        _compare("day_hour_emd"),
        S.with_(PAIR, _EMD, select=f"SELECT {S.rnd('sim_val', 'sim_val', 4)} FROM emd"),
    ),
    "log_metrics": (log_metrics, _runs_sql()),
    "pool_occupancy": (
        occupancy,
        S.with_(S.USER_LOG, S.ROLED, """
pool AS (SELECT role, count(DISTINCT usr) AS users FROM rg GROUP BY role),
chg AS (SELECT role, s_us AS us, 1 AS d FROM rg UNION ALL SELECT role, e_us, -1 FROM rg),
byrole AS (SELECT role, us, sum(sum(d)) OVER (PARTITION BY role ORDER BY us) AS busy FROM chg GROUP BY role, us),
every AS (SELECT us, sum(sum(d)) OVER (ORDER BY us) AS open FROM chg GROUP BY us)
""", select=f"""
            SELECT o1 AS event_id, rg.role, CAST(open AS BIGINT) AS open_events,
              CAST(busy AS BIGINT) AS role_busy, {S.r6("busy / users", "role_share")}
            FROM rg JOIN byrole b ON b.role = rg.role AND b.us = s_us
              JOIN every e ON e.us = s_us JOIN pool p ON p.role = rg.role"""),
    ),
}
