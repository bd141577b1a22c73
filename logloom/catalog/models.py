"""Registered queries: the n-gram model and what it predicts."""

from pyspark.sql import functions as F

from logloom.catalog import sql as S
from logloom.catalog.common import big, r6, text, user_roles
from logloom.catalog.encoding import _AUTO, _contained
from logloom.functions.times import micros
from logloom.operators.ngram import ARG_MAX, RANDOM_CHOICE, ngram_table, time_table
from logloom.plans.prediction import (
    generated_log, next_event_records, remaining_time, suffix_records,
)
from logloom.plans.training import fit, prepare, training_samples
from logloom.sources.adapters import user_day_log

N, MIN_SUPPORT, SEED = 3, 4, 11


def trained(spark, folder, model_type="shared_cat"):
    ready = prepare(user_roles(user_day_log(spark, folder)), model_type)
    return ready, fit(ready, N, MIN_SUPPORT)


def _ready_samples(spark, folder):
    ready = prepare(user_roles(user_day_log(spark, folder)), norm_method=None)
    samples = training_samples(ready, N)
    return samples.withColumnsRenamed({"dur_norm_next": "dur_next", "wait_norm_next": "wait_next"})


def ngram_model(spark, folder):
    samples = _ready_samples(spark, folder)
    heads = [
        ngram_table(samples, f"{h}_index_next", N).withColumn("head", F.lit(h)) for h in ("ac", "rl")
    ]
    table = heads[0].unionByName(heads[1])
    return table.select("head", big("k"), "ctx", big("next"), "n", "total", r6("p"))


def time_model(spark, folder):
    table = time_table(_ready_samples(spark, folder), ["dur", "wait"], N)
    return table.select(big("k"), "ctx", big("next"), r6("dur"), r6("wait"))


def _next_event(variant):
    def query(spark, folder):
        ready, model = trained(spark, folder)
        rows = next_event_records(ready, model, variant, SEED)
        return rows.select(
            "caseid", big("cut"), text("ac_prefix"),
            *[big(c) for c in ("ac_expect", "ac_pred", "rl_expect", "rl_pred")],
            *[r6(c) for c in ("dur_expect", "dur_pred", "wait_expect", "wait_pred")],
        )

    return query


def suffix_argmax(spark, folder):
    ready, model = trained(spark, folder)
    rows = suffix_records(ready, model)
    return rows.select(
        "caseid", big("pref_size"), text("ac_prefix"), text("ac_expect"), text("ac_pred"),
        text("rl_expect"), text("rl_pred"), text("dur_expect", 3), text("dur_pred", 3),
        text("wait_pred", 3),
    )


def suffix_sampled(spark, folder):
    ready, model = trained(spark, folder)
    rows = suffix_records(ready, model, RANDOM_CHOICE, SEED)
    return rows.select("caseid", big("pref_size"), text("ac_pred"), text("rl_pred"))


def remaining(spark, folder):
    ready, model = trained(spark, folder)
    rows = suffix_records(ready, model)
    return rows.select(
        "caseid", big("pref_size"), F.round(remaining_time(rows), 3).alias("remaining")
    )


def _generated(variant, context):
    def query(spark, folder):
        ready, model = trained(spark, folder, "shared_cat_cx" if context else "shared_cat")
        rows = generated_log(ready, model, variant, SEED, context=context)
        return rows.select(
            "caseid", "pos", "task", "role", micros("start_timestamp").alias("start_us"),
            micros("end_timestamp").alias("end_us"), F.round("dur", 3).alias("dur"),
            F.round("wait", 3).alias("wait"),
        )

    return query


# Splits, training samples, counts (m1), medians (m2) and choices per context.
MODEL = f"""
{S.PREPARED}, {_contained("dummy AS (SELECT 1)")},
parts AS ({_AUTO}),
tr AS (SELECT en.* FROM en JOIN parts USING (caseid) WHERE part = 'train'),
te AS (SELECT en.* FROM en JOIN parts USING (caseid) WHERE part = 'test'),
mts AS (SELECT max(len) AS mx FROM en),
trq AS (SELECT caseid, any_value(len) AS len, list(ac ORDER BY pos) AS a, list(rl ORDER BY pos) AS r,
    list(dur ORDER BY pos) AS d, list(wait ORDER BY pos) AS w FROM tr GROUP BY caseid),
teq AS (SELECT caseid, any_value(len) AS len, list(ac ORDER BY pos) AS a, list(rl ORDER BY pos) AS r,
    list(dur ORDER BY pos) AS d, list(wait ORDER BY pos) AS w FROM te GROUP BY caseid),
smp AS (SELECT caseid, cut, ([0, 0, 0, 0] || a)[cut + 2 : cut + 4] AS win,
    (a || [ac_end])[cut + 1] AS nx, (r || [rl_end])[cut + 1] AS rnx,
    (d || [0.0])[cut + 1] AS dnx, (w || [0.0])[cut + 1] AS wnx
  FROM trq, nd, LATERAL (SELECT unnest(range(len + 1)) AS cut)),
cx AS (SELECT k, array_to_string(win[4 - k : 3], ',') AS ctx, nx, rnx, dnx, wnx
  FROM smp, LATERAL (SELECT unnest(range(4)) AS k)),
m1 AS (SELECT 'ac' AS head, k, ctx, nx, count(*) AS n,
    CAST(sum(count(*)) OVER (PARTITION BY k, ctx) AS BIGINT) AS total FROM cx GROUP BY k, ctx, nx
  UNION ALL SELECT 'rl', k, ctx, rnx, count(*),
    CAST(sum(count(*)) OVER (PARTITION BY k, ctx) AS BIGINT) FROM cx GROUP BY k, ctx, rnx),
m2 AS (SELECT k, ctx, nx, quantile_disc(dnx, 0.5) AS dm, quantile_disc(wnx, 0.5) AS wm
  FROM cx GROUP BY 1, 2, 3)
"""
STATES = f"""
{MODEL},
-- The end sentinel is 0 on the scale of the training times, their minimum in seconds.
lows AS (SELECT min(dur) AS dmin, min(wait) AS wmin FROM tr),
ch AS (SELECT m1.head, m1.k, m1.ctx, m1.nx, m1.n, m1.total,
    CASE WHEN m1.head = 'ac' AND m1.nx = ac_end THEN dmin ELSE dm END AS dm,
    CASE WHEN m1.head = 'ac' AND m1.nx = ac_end THEN wmin ELSE wm END AS wm,
    sum(n) OVER (PARTITION BY head, m1.ctx ORDER BY m1.nx) AS upto,
    row_number() OVER (PARTITION BY head, m1.ctx ORDER BY n DESC, m1.nx) AS rn
  FROM nd, lows, m1 LEFT JOIN m2 ON m1.head = 'ac' AND m1.ctx = m2.ctx AND m1.nx = m2.nx
  WHERE total >= {MIN_SUPPORT} OR m1.k = 0),
sx AS (SELECT DISTINCT k, ctx FROM ch),
tes AS (SELECT caseid, cut, len, ([0, 0, 0, 0] || a)[cut + 2 : cut + 4] AS win, a, r, d, w
  FROM teq, LATERAL (SELECT unnest(range(len + 1)) AS cut))
"""


def longest_context(window: str) -> str:
    """Correlated choice of the longest supported context of a window."""
    keys = [f"array_to_string({window}[{4 - k} : 3], ',')" for k in (3, 2, 1)]
    tests = [f"WHEN {key} IN (SELECT ctx FROM sx) THEN {key}" for key in keys]
    return "CASE " + " ".join(tests) + " ELSE '' END"


def draw(salt: str, *keys: str) -> str:
    return (
        f"(CAST('0x' || substr(md5(concat_ws('|', '{salt}', {', '.join(keys)})), 1, 8) AS BIGINT)"
        " / 4294967296.0)"
    )


_RESOLVED = f"rs AS (SELECT *, {longest_context('win')} AS ctx FROM tes)"
_NEXT_COLUMNS = f"""
    caseid, cut, array_to_string(win, ',') AS ac_prefix, a[cut + 1] AS ac_expect, c.nx AS ac_pred,
    r[cut + 1] AS rl_expect, q.nx AS rl_pred, {S.r6("d[cut + 1]", "dur_expect")},
    {S.r6("c.dm", "dur_pred")}, {S.r6("w[cut + 1]", "wait_expect")}, {S.r6("c.wm", "wait_pred")}
"""
_RUN = f"'{SEED}-0'"


def _drawn(alias, head, salt, keys, key="rs.ctx", run=_RUN):
    """Join condition: the choice whose share holds the draw."""
    u = draw(salt, *keys, run)
    return (
        f"{alias}.head = '{head}' AND {alias}.ctx = {key} AND {alias}.upto > {u} * {alias}.total"
        f" AND {alias}.upto - {alias}.n <= {u} * {alias}.total"
    )


def walk_sql(clause: str, salted: bool, case: str = "h.id", run: str = _RUN) -> str:
    """Recursive steps from ``clause`` rows (id, win): wk(id, step, nx, rnx, dm, wm, win)."""
    if salted:
        ac = _drawn("c", "ac", "ac", [case, "h.step + 1"], "h.ctx", run)
        rl = _drawn("q", "rl", "rl", [case, "h.step + 1"], "h.ctx", run)
    else:
        ac = "c.head = 'ac' AND c.ctx = h.ctx AND c.rn = 1"
        rl = "q.head = 'rl' AND q.ctx = h.ctx AND q.rn = 1"
    return f"""
wk AS (
  SELECT id, 0 AS step, CAST(-1 AS BIGINT) AS nx, CAST(-1 AS BIGINT) AS rnx,
    CAST(NULL AS DOUBLE) AS dm, CAST(NULL AS DOUBLE) AS wm, win FROM {clause}
  UNION ALL
  SELECT h.id, h.step + 1, c.nx, q.nx, c.dm, c.wm, h.win[2:] || [c.nx]
  FROM (SELECT wk.*, {longest_context("wk.win")} AS ctx FROM wk, nd, mts
      WHERE nx <> ac_end AND step < mx - 1) h
    JOIN ch c ON {ac} JOIN ch q ON {rl})
"""


_PER_CUT = "w0 AS (SELECT caseid || '|' || cut AS id, win FROM tes)"
_SUFFIX = f"""
sf AS (SELECT id, array_to_string(list(nx ORDER BY step), ',') AS ac_pred,
    array_to_string(list(rnx ORDER BY step), ',') AS rl_pred,
    array_to_string(list(printf('%.3f', dm) ORDER BY step), ',') AS dur_pred,
    array_to_string(list(printf('%.3f', wm) ORDER BY step), ',') AS wait_pred,
    round(sum(dm + wm), 3) AS remaining FROM wk WHERE step > 0 GROUP BY id)
"""

_CASES = """
w0 AS (SELECT 'Case' || lpad(CAST(i AS VARCHAR), CAST(length(CAST(nc AS VARCHAR)) AS INT), '0') AS id, [0, 0, 0] AS win
  FROM (SELECT count(DISTINCT caseid) AS nc FROM te), LATERAL (SELECT unnest(range(nc)) AS i))
"""
# The start context never goes to `end`, so no first event needs to be redrawn.
GENERATED = """
acl AS (SELECT * FROM aci UNION ALL SELECT 'start', 0 UNION ALL SELECT 'end', ac_end FROM nd),
rll AS (SELECT * FROM rli UNION ALL SELECT 'start', 0 UNION ALL SELECT 'end', rl_end FROM nd),
us AS (SELECT id, step, nx, rnx, dm, wm, CAST(round(dm * 1e6) AS BIGINT) AS d,
    CAST(round(wm * 1e6) AS BIGINT) AS w FROM wk WHERE step > 0),
gl AS (SELECT id AS caseid, step - 1 AS pos, a.value AS task, r.value AS role, dm, wm, d,
    (SELECT min(k_us) FROM te) + CAST(sum(d + w) OVER (PARTITION BY id ORDER BY step) AS BIGINT) AS e_us
  FROM us JOIN acl a ON a.idx = nx JOIN rll r ON r.idx = rnx, nd WHERE nx <> ac_end)
"""
_GENERATED_ROWS = """
SELECT caseid, CAST(pos AS BIGINT) AS pos, task, role, e_us - d AS start_us, e_us AS end_us,
  round(dm, 3) AS dur, round(wm, 3) AS wait FROM gl
"""
# Choices keyed by context, or by context, hour and weekday of the last event.
_TIMED = f"""
tpq AS (SELECT caseid, [0] || list(daytime // 3600 ORDER BY pos) AS hs,
    [0] || list(weekday ORDER BY pos) AS ds FROM tr GROUP BY caseid),
tcx AS (SELECT {longest_context("smp.win")} AS ctx, hs[cut + 1] AS hour, ds[cut + 1] AS wd, nx
  FROM smp JOIN tpq USING (caseid)),
tch AS (SELECT ctx, ctx || '@' || hour || '@' || wd AS key, nx, count(*) AS n,
    sum(count(*)) OVER (PARTITION BY ctx, hour, wd ORDER BY nx) AS upto,
    sum(count(*)) OVER (PARTITION BY ctx, hour, wd) AS total
  FROM tcx GROUP BY ctx, hour, wd, nx),
xch AS (SELECT ctx AS key, nx, n, upto, total, dm, wm FROM ch WHERE head = 'ac'
  UNION ALL SELECT tch.key, tch.nx, tch.n, tch.upto, tch.total, ch.dm, ch.wm
  FROM tch JOIN ch ON ch.head = 'ac' AND ch.ctx = tch.ctx AND ch.nx = tch.nx),
xk AS (SELECT DISTINCT key FROM tch),
t0 AS (SELECT min(k_us) AS t FROM te),
wk AS (
  SELECT id, 0 AS step, CAST(0 AS BIGINT) AS nx, CAST(0 AS BIGINT) AS rnx, CAST(NULL AS DOUBLE) AS dm,
    CAST(NULL AS DOUBLE) AS wm, win, t AS s_us, t AS e_us FROM w0, t0
  UNION ALL
  SELECT h.id, h.step + 1, c.nx, q.nx, c.dm, c.wm, h.win[2:] || [c.nx],
    h.e_us + CAST(round(c.wm * 1e6) AS BIGINT),
    h.e_us + CAST(round(c.wm * 1e6) AS BIGINT) + CAST(round(c.dm * 1e6) AS BIGINT)
  FROM (SELECT *, CASE WHEN tkey IN (SELECT key FROM xk) THEN tkey ELSE ctx END AS key
      FROM (SELECT *, ctx || '@' || (s_us // 3600000000) % 24 || '@'
          || (isodow(make_timestamp(s_us)) - 1) AS tkey
        FROM (SELECT wk.*, {longest_context("wk.win")} AS ctx FROM wk, nd, mts
          WHERE nx <> ac_end AND step < mx - 1))) h
    JOIN xch c ON c.key = h.key AND c.upto > {draw("ac", "h.id", "h.step + 1", _RUN)} * c.total
      AND c.upto - c.n <= {draw("ac", "h.id", "h.step + 1", _RUN)} * c.total
    JOIN ch q ON {_drawn("q", "rl", "rl", ["h.id", "h.step + 1"], "h.ctx")})
"""

QUERIES = {
    "ngram_model": (
        ngram_model,
        S.with_(MODEL, select=f"""
            SELECT head, k, ctx, nx AS next, n, total, {S.r6("n / total", "p")} FROM m1"""),
    ),
    "time_model": (
        time_model,
        S.with_(MODEL, select=f"""
            SELECT k, ctx, nx AS next, {S.r6("dm", "dur")}, {S.r6("wm", "wait")} FROM m2"""),
    ),
    "next_event_argmax": (
        _next_event(ARG_MAX),
        S.with_(STATES, _RESOLVED, select=f"""
            SELECT {_NEXT_COLUMNS} FROM rs
            JOIN ch c ON c.head = 'ac' AND c.ctx = rs.ctx AND c.rn = 1
            JOIN ch q ON q.head = 'rl' AND q.ctx = rs.ctx AND q.rn = 1
            WHERE cut < len"""),
    ),
    "next_event_sampled": (
        _next_event(RANDOM_CHOICE),
        S.with_(STATES, _RESOLVED, select=f"""
            SELECT {_NEXT_COLUMNS} FROM rs
            JOIN ch c ON {_drawn("c", "ac", "ac", ["caseid", "cut"])}
            JOIN ch q ON {_drawn("q", "rl", "rl", ["caseid", "cut"])}
            WHERE cut < len"""),
    ),
    "suffix_argmax": (
        suffix_argmax,
        S.with_("RECURSIVE " + STATES, _PER_CUT, walk_sql("w0", False), _SUFFIX, select="""
            SELECT caseid, cut + 1 AS pref_size, array_to_string([0] || a[1 : cut], ',') AS ac_prefix,
              array_to_string((a || [ac_end])[cut + 1 : len + 1], ',') AS ac_expect, ac_pred,
              array_to_string((r || [rl_end])[cut + 1 : len + 1], ',') AS rl_expect, rl_pred,
              array_to_string(list_transform((d || [dmin])[cut + 1 : len + 1],
                lambda x: printf('%.3f', x)), ',') AS dur_expect, dur_pred, wait_pred
            FROM tes JOIN sf ON sf.id = caseid || '|' || cut, nd, lows"""),
    ),
    "suffix_sampled": (
        suffix_sampled,
        S.with_("RECURSIVE " + STATES, _PER_CUT, walk_sql("w0", True), _SUFFIX, select="""
            SELECT caseid, cut + 1 AS pref_size, ac_pred, rl_pred
            FROM tes JOIN sf ON sf.id = caseid || '|' || cut"""),
    ),
    "remaining_time": (
        remaining,
        S.with_("RECURSIVE " + STATES, _PER_CUT, walk_sql("w0", False), _SUFFIX, select="""
            SELECT caseid, cut + 1 AS pref_size, remaining
            FROM tes JOIN sf ON sf.id = caseid || '|' || cut"""),
    ),
    "generated_log": (
        _generated(RANDOM_CHOICE, False),
        S.with_("RECURSIVE " + STATES, _CASES, walk_sql("w0", True), GENERATED, select=_GENERATED_ROWS),
    ),
    "generated_log_argmax": (
        _generated(ARG_MAX, False),
        S.with_("RECURSIVE " + STATES, _CASES, walk_sql("w0", False), GENERATED, select=_GENERATED_ROWS),
    ),
    "generated_log_ctx": (
        _generated(RANDOM_CHOICE, True),
        S.with_("RECURSIVE " + STATES, _CASES, _TIMED, GENERATED.split("us AS")[0].rstrip().rstrip(","),
            select="""
            SELECT id AS caseid, CAST(step AS BIGINT) AS pos, a.value AS task, r.value AS role,
              s_us AS start_us, e_us AS end_us, round(dm, 3) AS dur, round(wm, 3) AS wait
            FROM wk JOIN acl a ON a.idx = nx JOIN rll r ON r.idx = rnx"""),
    ),
}
