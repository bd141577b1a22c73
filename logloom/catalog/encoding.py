"""Registered queries: indexes, roles, splits and pairs."""

from pyspark.sql import functions as F

from logloom.catalog import sql as S
from logloom.catalog.common import INTERVAL, POINT, big, prepared, r6, user_roles
from logloom.functions.times import micros
from logloom.operators.encode import build_index, decode, encode_log, log_extent, max_trace_size
from logloom.operators.pairs import negative_samples, observed_pairs, unobserved_pairs
from logloom.operators.roles import (
    add_resources, connected_components, discover_roles, role_members, similar_users,
    task_user_counts, user_task_profiles,
)
from logloom.operators.split import label_parts
from logloom.sources.adapters import order_log, shipment_log, user_day_log, user_log

SIMILAR = 0.95
SEED = 7


def activity_index(spark, folder):
    index = build_index(user_log(spark, folder), "task")
    return index.table.select("value", big("idx"))


def coded_log(spark, folder):
    log, activities, _ = encode_log(user_roles(user_day_log(spark, folder)))
    log = decode(log, activities, "ac_index", "label")
    return log.select(
        big("event_key", "event_id"), "label", "role", big("ac_index"), big("rl_index")
    )


def longest_case(spark, folder):
    return max_trace_size(user_log(spark, folder))


def extent(spark, folder):
    out = log_extent(user_day_log(spark, folder))
    return out.select("num_cases", micros("start_time").alias("start_us"))


def activity_user_counts(spark, folder):
    return task_user_counts(user_log(spark, folder))


def profiles(spark, folder):
    return user_task_profiles(user_log(spark, folder))


def similarity(spark, folder):
    return similar_users(user_log(spark, folder), 0.7).select("x", "y", r6("r"))


def role_table(spark, folder):
    return discover_roles(user_log(spark, folder), SIMILAR)


def role_table_giant(spark, folder):
    return discover_roles(user_log(spark, folder), 0.85)


def role_lists(spark, folder):
    roles = discover_roles(user_log(spark, folder), SIMILAR)
    return role_members(roles).select(
        "role", "quantity", big("chunk"), F.array_join("members", ",").alias("members")
    )


def log_with_roles(spark, folder):
    log = add_resources(user_log(spark, folder), SIMILAR)
    return log.select(big("event_key", "event_id"), "user", "role")


def components(spark, folder):
    log = user_log(spark, folder)
    users = log.select(F.col("user").alias("node")).distinct()
    return connected_components(users, similar_users(log, SIMILAR))


def _split(adapter, schema, method):
    def query(spark, folder):
        parts = label_parts(adapter(spark, folder), schema, 0.8, method)
        return parts.groupBy("caseid", "part").agg(F.count(F.lit(1)).alias("events"))

    return query


def ac_rl_pairs(spark, folder):
    log, _, _, _ = prepared(spark, folder)
    return observed_pairs(log).select(big("ac_index"), big("rl_index"), "n")


def free_pairs(spark, folder):
    log, activities, roles, _ = prepared(spark, folder)
    free = unobserved_pairs(log, activities.size, roles.size)
    return free.select(big("ac_index"), big("rl_index"))


def sampled_pairs(spark, folder):
    log, activities, roles, _ = prepared(spark, folder)
    rows = negative_samples(log, activities.size, roles.size, SEED)
    return rows.select(big("ac_index"), big("rl_index"), big("label"), "shuffle_key")


_PROFILE = """
cnt AS (SELECT task, usr, count(*) AS freq FROM lg
  WHERE task NOT IN ('Start', 'End') AND usr IS DISTINCT FROM 'AUTO' GROUP BY 1, 2),
prf AS (SELECT u.usr, t.task, coalesce(c.freq, 0) AS freq
  FROM (SELECT DISTINCT usr FROM cnt) u CROSS JOIN (SELECT DISTINCT task FROM cnt) t
  LEFT JOIN cnt c ON c.usr = u.usr AND c.task = t.task),
sim AS (SELECT x, y, (n * sxy - sx * sy)
      / nullif(sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy), 0) AS r
  FROM (SELECT a.usr AS x, b.usr AS y, CAST(count(*) AS DOUBLE) AS n,
      CAST(sum(a.freq) AS DOUBLE) AS sx, CAST(sum(b.freq) AS DOUBLE) AS sy,
      CAST(sum(a.freq * b.freq) AS DOUBLE) AS sxy, CAST(sum(a.freq * a.freq) AS DOUBLE) AS sxx,
      CAST(sum(b.freq * b.freq) AS DOUBLE) AS syy
    FROM prf a JOIN prf b ON a.task = b.task AND a.usr < b.usr GROUP BY 1, 2))
"""


def _roles_sql(threshold):
    return f"""
RECURSIVE {S.USER_LOG}, {_PROFILE},
edge AS (SELECT x, y FROM sim WHERE r > {threshold} UNION ALL SELECT y, x FROM sim WHERE r > {threshold}),
reach AS (SELECT DISTINCT usr AS a, usr AS b FROM cnt
  UNION SELECT reach.a, edge.y FROM reach JOIN edge ON reach.b = edge.x),
comp AS (SELECT a AS usr, min(b) AS component FROM reach GROUP BY a),
roles AS (SELECT usr, component, 'Role ' || dense_rank() OVER (ORDER BY n DESC, component) AS role, n
  FROM (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM comp))
"""


def _contained(log, size="0.8"):
    return f"""{log},
cut AS (SELECT quantile_disc(k_us, {size}) AS t FROM lg),
sp AS (SELECT caseid, count(*) AS events, min(k_us) AS f, max(e_us) AS l FROM lg GROUP BY caseid),
con AS (SELECT caseid, events, CASE WHEN l <= t THEN 'train' ELSE 'test' END AS part
  FROM sp, cut WHERE l <= t OR f > t),
tra AS (SELECT caseid, events,
    CASE WHEN row_number() OVER (ORDER BY f, caseid) <= ceil({size} * count(*) OVER ())
      THEN 'train' ELSE 'test' END AS part FROM sp)
"""


_AUTO = """
SELECT * FROM con WHERE (SELECT coalesce(sum(events), 0) FROM con WHERE part = 'test')
    >= (SELECT count(*) // 10 FROM lg)
UNION ALL
SELECT * FROM tra WHERE (SELECT coalesce(sum(events), 0) FROM con WHERE part = 'test')
    < (SELECT count(*) // 10 FROM lg)
"""

_DRAW = "CAST('0x' || substr(md5({}), 1, {}) AS BIGINT)"

QUERIES = {
    "activity_index": (
        activity_index,
        S.with_(S.USER_LOG, "a AS (SELECT DISTINCT task FROM lg)", select="""
            SELECT task AS value, row_number() OVER (ORDER BY task) AS idx FROM a
            UNION ALL SELECT 'start', 0 UNION ALL SELECT 'end', count(*) + 1 FROM a"""),
    ),
    "encode_log": (
        coded_log,
        S.with_(S.PREPARED, select="""
            SELECT o1 AS event_id, task AS label, role, ac AS ac_index, rl AS rl_index FROM en"""),
    ),
    "max_trace_size": (
        longest_case,
        S.with_(S.USER_LOG, select="""
            SELECT max(n) AS max_trace_size FROM (SELECT count(*) AS n FROM lg GROUP BY caseid)"""),
    ),
    "log_extent": (
        extent,
        S.with_(S.USER_DAY_LOG, select="""
            SELECT count(DISTINCT caseid) AS num_cases, min(s_us) AS start_us FROM lg"""),
    ),
    "task_user_counts": (
        activity_user_counts,
        S.with_(S.USER_LOG, select="""
            SELECT task, usr AS "user", count(*) AS freq FROM lg GROUP BY 1, 2"""),
    ),
    "user_task_profile": (
        profiles,
        S.with_(S.USER_LOG, _PROFILE, select='SELECT usr AS "user", task, freq FROM prf'),
    ),
    "user_similarity": (
        similarity,
        S.with_(S.USER_LOG, _PROFILE, select=f"SELECT x, y, {S.r6('r')} FROM sim WHERE r > 0.7"),
    ),
    "connected_components": (
        components,
        S.with_(_roles_sql(SIMILAR), select="SELECT usr AS node, component FROM comp"),
    ),
    "role_table": (
        role_table,
        S.with_(_roles_sql(SIMILAR), select='SELECT usr AS "user", role FROM roles'),
    ),
    "role_table_giant": (
        role_table_giant,
        S.with_(_roles_sql(0.85), select='SELECT usr AS "user", role FROM roles'),
    ),
    "role_members": (
        role_lists,
        S.with_(_roles_sql(SIMILAR), select="""
            SELECT role, count(*) AS quantity, CAST(0 AS BIGINT) AS chunk,
              string_agg(usr, ',' ORDER BY usr) AS members FROM roles GROUP BY role"""),
    ),
    "log_with_roles": (
        log_with_roles,
        S.with_(_roles_sql(SIMILAR), select="""
            SELECT o1 AS event_id, lg.usr AS "user", role FROM lg LEFT JOIN roles USING (usr)"""),
    ),
    "split_contained": (
        _split(user_day_log, INTERVAL, "contained"),
        S.with_(_contained(S.USER_DAY_LOG), select="SELECT caseid, part, events FROM con"),
    ),
    "split_trace": (
        _split(shipment_log, INTERVAL, "trace"),
        S.with_(_contained(S.SHIPMENT_LOG), select="SELECT caseid, part, events FROM tra"),
    ),
    "split_auto": (
        _split(user_day_log, INTERVAL, "auto"),
        S.with_(_contained(S.USER_DAY_LOG), select=_AUTO),
    ),
    "split_auto_fallback": (
        _split(order_log, POINT, "auto"),
        S.with_(_contained(S.ORDER_LOG), select=_AUTO),
    ),
    "ac_rl_pairs": (
        ac_rl_pairs,
        S.with_(S.PREPARED, select="""
            SELECT ac AS ac_index, rl AS rl_index, count(*) AS n FROM en GROUP BY 1, 2"""),
    ),
    "unobserved_pairs": (
        free_pairs,
        S.with_(S.PREPARED, select="""
            SELECT a.i AS ac_index, r.i AS rl_index FROM nd,
              LATERAL (SELECT unnest(range(ac_end + 1)) AS i) a,
              LATERAL (SELECT unnest(range(rl_end + 1)) AS i) r
            WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.ac = a.i AND en.rl = r.i)"""),
    ),
    "negative_samples": (
        sampled_pairs,
        S.with_(S.PREPARED, f"""
free AS (SELECT a.i AS ac, r.i AS rl, row_number() OVER (ORDER BY a.i, r.i) AS rank FROM nd,
    LATERAL (SELECT unnest(range(ac_end + 1)) AS i) a,
    LATERAL (SELECT unnest(range(rl_end + 1)) AS i) r
  WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.ac = a.i AND en.rl = r.i)),
np AS (SELECT CAST(round(count(*) / 3) AS BIGINT) AS k FROM en),
dr AS (SELECT ac, rl, caseid, k_us, o1,
    {_DRAW.format(f"concat_ws('|', caseid, k_us, o1, {SEED})", 15)} AS key FROM en),
pos AS (SELECT ac, rl, 1 AS label, key FROM (
    SELECT *, row_number() OVER (ORDER BY key, caseid, k_us, o1) AS rn FROM dr), np WHERE rn <= k),
neg AS (SELECT ac, rl, 0 AS label, i AS key FROM (
    SELECT i, CAST(floor({_DRAW.format(f"concat_ws('|', 'negative', i, {SEED})", 8)}
      / 4294967296.0 * (SELECT count(*) FROM free)) AS BIGINT) + 1 AS rank
    FROM np, LATERAL (SELECT unnest(range(2 * k)) AS i)) JOIN free USING (rank))
""", select=f"""
            SELECT ac AS ac_index, rl AS rl_index, CAST(label AS BIGINT) AS label,
              {_DRAW.format(f"concat_ws('|', label, key, {SEED})", 15)} AS shuffle_key
            FROM (SELECT * FROM pos UNION ALL SELECT * FROM neg)"""),
    ),
}
