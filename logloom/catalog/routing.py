"""Registered queries: next events by model types that route features to their heads."""

from pyspark.sql import functions as F

from logloom.catalog import models as M
from logloom.catalog import sql as S
from logloom.catalog.common import big, r6, user_roles
from logloom.operators.routing import successive_halving
from logloom.operators.samples import ngram_samples
from logloom.operators.trials import config_grid
from logloom.plans.prediction import fit_heads, routed_columns, routed_records
from logloom.plans.specs import ACTIVITIES, CONTEXT, ROLES, TIMES, model_spec
from logloom.plans.training import prepare
from logloom.sources.adapters import user_day_log

TYPES = ("specialized", "shared_cat", "concatenated", "shared_cat_cx", "concatenated_cx")


def _next_events(model_type):
    def query(spark, folder):
        ready = prepare(user_roles(user_day_log(spark, folder)), model_type)
        rows = routed_records(ready, fit_heads(ready, M.N, M.MIN_SUPPORT))
        return rows.select(
            "caseid",
            *[big(c) for c in ("cut", "ac_expect", "ac_pred", "rl_expect", "rl_pred")],
            *[r6(c) for c in ("dur_expect", "dur_pred", "wait_expect", "wait_pred")],
        )

    return query


# Per cut: the last three activities and roles, the size of the last times, the clock.
_SEEN = f"""
rq AS (SELECT part = 'train' AS train, caseid, any_value(len) AS len, list(ac ORDER BY pos) AS a,
    list(rl ORDER BY pos) AS r, list(dur ORDER BY pos) AS d, list(wait ORDER BY pos) AS w,
    list(daytime // 3600 ORDER BY pos) AS h, list(weekday ORDER BY pos) AS y
  FROM en JOIN parts USING (caseid) GROUP BY part, caseid),
sn AS (SELECT train, caseid, cut, len, ([0, 0, 0, 0] || a)[cut + 2 : cut + 4] AS wa,
    ([0, 0, 0, 0] || r)[cut + 2 : cut + 4] AS wr,
    concat_ws(':', length(bin(CAST(floor(([0.0] || d)[cut + 1]) AS BIGINT))),
      length(bin(CAST(floor(([0.0] || w)[cut + 1]) AS BIGINT)))) AS tm,
    concat_ws(':', ([0] || h)[cut + 1], ([0] || y)[cut + 1]) AS ck,
    (a || [ac_end])[cut + 1] AS ac, (r || [rl_end])[cut + 1] AS rl,
    (d || [0.0])[cut + 1] AS dur, (w || [0.0])[cut + 1] AS wait
  FROM rq, nd, LATERAL (SELECT unnest(range(len + 1)) AS cut))
"""


def _levels(groups) -> list[tuple[int, str]]:
    both = "list_transform(range(1, 4), lambda i: wa[i] || ':' || wr[i])"
    seen = {(True, True): both, (True, False): "wa", (False, True): "wr"}.get((ACTIVITIES in groups, ROLES in groups))
    beside = [c for g, c in ((TIMES, "tm"), (CONTEXT, "ck")) if g in groups]
    out = []
    for k in range(M.N + 1 if seen else 1):
        ctx = f"array_to_string(({seen})[{4 - k} : 3], ',')" if k else "''"
        out.append((2 * k, ctx))
        if beside:
            out.append((2 * k + 1, f"concat_ws('|', {ctx}, {', '.join(beside)})"))
    return out


def _sql(model_type):
    heads = model_spec(model_type).heads
    each = " UNION ALL ".join(
        f"SELECT '{head}' AS head, {level} AS level, {ctx} AS ctx, sn.* FROM sn"
        for head, groups in heads.items()
        for level, ctx in _levels(groups)
    )
    return S.with_(M.MODEL, _SEEN, f"""
lv AS ({each}),
lc AS (SELECT head, level, ctx, CASE head WHEN 'ac' THEN ac ELSE rl END AS nx, count(*) AS n
  FROM lv WHERE train AND head <> 'time' GROUP BY ALL),
lb AS (SELECT head, level, ctx, nx FROM (
    SELECT *, sum(n) OVER (PARTITION BY head, level, ctx) AS total,
      row_number() OVER (PARTITION BY head, level, ctx ORDER BY n DESC, nx) AS rn FROM lc)
  WHERE rn = 1 AND (total >= {M.MIN_SUPPORT} OR level = 0)),
lt AS (SELECT level, ctx, quantile_disc(dur, 0.5) AS dm, quantile_disc(wait, 0.5) AS wm
  FROM lv, nd WHERE train AND head = 'time' AND ac <> ac_end GROUP BY level, ctx
  HAVING count(*) >= {M.MIN_SUPPORT} OR level = 0),
fb AS (SELECT caseid, cut, max_by(nx, level) FILTER (head = 'ac') AS ac_pred,
    max_by(nx, level) FILTER (head = 'rl') AS rl_pred
  FROM lv JOIN lb USING (head, level, ctx) WHERE NOT train AND cut < len GROUP BY caseid, cut),
ftm AS (SELECT caseid, cut, max_by(dm, level) AS dur_pred, max_by(wm, level) AS wait_pred
  FROM lv JOIN lt USING (level, ctx) WHERE head = 'time' AND NOT train AND cut < len GROUP BY caseid, cut)
""", select=f"""
        SELECT caseid, cut, ac AS ac_expect, ac_pred, rl AS rl_expect, rl_pred, {S.r6("dur", "dur_expect")},
          {S.r6("dur_pred", "dur_pred")}, {S.r6("wait", "wait_expect")}, {S.r6("wait_pred", "wait_pred")}
        FROM sn JOIN fb USING (caseid, cut) JOIN ftm USING (caseid, cut)
        WHERE NOT train AND cut < len""")


SPACE = {"model_type": list(TYPES), "n_size": [1, 2, 3], "norm_method": ["max", "lognorm"]}
SHARES = (0.25, 0.5, 1.0)


def config_search(spark, folder):
    """Successive halving over model types, window sizes and scales."""
    ready = prepare(user_roles(user_day_log(spark, folder)), norm_method=None)
    columns = routed_columns(ready)
    train, valid = (ngram_samples(x, columns, 3, ready.ends, hot=ready.hot) for x in (ready.train, ready.test))
    heads = {t: model_spec(t).heads for t in TYPES}
    rows = successive_halving(
        train, valid, config_grid(spark, SPACE), heads, ready.activities.end, ready.schema.times, SHARES, M.SEED
    )
    return rows.select(big("rung"), "model_type", big("n_size"), "norm_method", F.round("loss", 5).alias("loss"))


def _search_sql():
    heads_of = {t: model_spec(t).heads for t in TYPES}
    routes = {h: sorted({x[h] for x in heads_of.values()}) for h in ("ac", "rl", "time")}
    each = " UNION ALL ".join(
        f"SELECT '{h}' AS head, {i} AS route, {level} AS level, {ctx} AS ctx, sn.* FROM sn"
        for h, sets in routes.items() for i, groups in enumerate(sets) for level, ctx in _levels(groups)
    )
    types = ", ".join(
        f"('{t}', {', '.join(str(routes[h].index(x[h])) for h in ('ac', 'rl', 'time'))})" for t, x in heads_of.items()
    )
    scaled = {
        "max": lambda x, f: f"{x} / {f}max",
        "lognorm": lambda x, f: f"(ln(1 + {x}) - {f}lo) / ({f}hi - {f}lo)",
    }
    mae = lambda m: " + ".join(
        f"abs(CASE WHEN ac = ac_end THEN 0 ELSE {scaled[m](x, f)} END - {scaled[m](y, f)})"
        for x, y, f in (("dur", "dm", "d"), ("wait", "wm", "w"))
    )
    clauses, selects = [], []
    for k, share in enumerate(SHARES):
        # configurations of the rung: all, or the better half of the one before
        if k == 0:
            cf = f"""cf0 AS (SELECT * FROM (VALUES {types}) t(model_type, ra, rr, rt),
                (VALUES (1), (2), (3)) s(n_size), (VALUES ('max'), ('lognorm')) m(norm_method))"""
        else:
            cf = f"""cf{k} AS (SELECT model_type, ra, rr, rt, n_size, norm_method FROM (SELECT *,
                row_number() OVER (ORDER BY loss, model_type, n_size, norm_method) AS rn, count(*) OVER () AS c
                FROM ls{k - 1}) WHERE rn <= (c + 1) // 2)"""
        u = M.draw("rung", "caseid", f"'{M.SEED}'")
        clauses.append(f"""{cf},
tn{k} AS (SELECT * FROM lv WHERE train AND {u} < {share}),
lim{k} AS (SELECT max(dur) AS dmax, max(wait) AS wmax, min(ln(1 + dur)) AS dlo, max(ln(1 + dur)) AS dhi,
    min(ln(1 + wait)) AS wlo, max(ln(1 + wait)) AS whi FROM tn{k}, nd WHERE ac <> ac_end),
lc{k} AS (SELECT head, route, level, ctx, nx, n, sum(n) OVER (PARTITION BY head, route, level, ctx) AS total FROM (
    SELECT head, route, level, ctx, CASE head WHEN 'ac' THEN ac ELSE rl END AS nx, count(*) AS n
    FROM tn{k} WHERE head <> 'time' GROUP BY ALL)),
lk{k} AS (SELECT DISTINCT head, route, level, ctx, total FROM lc{k}),
lt{k} AS (SELECT route, level, ctx, quantile_disc(dur, 0.5) AS dm, quantile_disc(wait, 0.5) AS wm
  FROM tn{k}, nd WHERE head = 'time' AND ac <> ac_end GROUP BY ALL),
vc{k} AS (SELECT caseid, cut, head, route, n_size, any_value(CASE head WHEN 'ac' THEN ac ELSE rl END) AS nx,
    max_by({{'level': level, 'ctx': ctx, 'total': total}}, level) AS f
  FROM lv JOIN lk{k} USING (head, route, level, ctx), (VALUES (1), (2), (3)) s(n_size)
  WHERE NOT train AND level <= 2 * n_size + 1 GROUP BY caseid, cut, head, route, n_size),
ce{k} AS (SELECT vc{k}.head, vc{k}.route, n_size, avg(-ln(greatest(coalesce(n / f.total, 0), 1e-7))) AS ce
  FROM vc{k} LEFT JOIN lc{k} c ON c.head = vc{k}.head AND c.route = vc{k}.route AND c.level = f.level
    AND c.ctx = f.ctx AND c.nx = vc{k}.nx GROUP BY ALL),
vt{k} AS (SELECT caseid, cut, route, n_size, any_value(ac) AS ac, any_value(dur) AS dur, any_value(wait) AS wait,
    max_by(dm, level) AS dm, max_by(wm, level) AS wm
  FROM lv JOIN lt{k} USING (route, level, ctx), (VALUES (1), (2), (3)) s(n_size)
  WHERE head = 'time' AND NOT train AND level <= 2 * n_size + 1 GROUP BY caseid, cut, route, n_size),
er{k} AS (SELECT route, n_size, avg(({mae("max")}) / 2) AS emax, avg(({mae("lognorm")}) / 2) AS elog
  FROM vt{k}, lim{k}, nd GROUP BY ALL),
ls{k} AS (SELECT cf{k}.*, a.ce + b.ce + CASE norm_method WHEN 'max' THEN emax ELSE elog END AS loss FROM cf{k}
  JOIN ce{k} a ON a.head = 'ac' AND a.route = ra AND a.n_size = cf{k}.n_size
  JOIN ce{k} b ON b.head = 'rl' AND b.route = rr AND b.n_size = cf{k}.n_size
  JOIN er{k} e ON e.route = rt AND e.n_size = cf{k}.n_size)
""")
        selects.append(f"""SELECT CAST({k} AS BIGINT) AS rung, model_type, CAST(n_size AS BIGINT) AS n_size,
            norm_method, {S.rnd("loss", "loss", 5)} FROM ls{k}""")
    return S.with_(M.MODEL, _SEEN, f"lv AS ({each})", *clauses, select=" UNION ALL ".join(selects))


QUERIES = {f"next_event_{t}": (_next_events(t), _sql(t)) for t in TYPES}
QUERIES["config_search"] = (config_search, _search_sql())
