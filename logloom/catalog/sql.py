"""Shared WITH-clauses of the reference SQL, in DuckDB's dialect.

Each log clause yields (caseid, task, usr, s_us, e_us, k_us, o1, o2, o3), times
in microseconds; (k_us, o1, o2, o3) is the event order.
"""

_EVENTS = """
    event_type AS task, regexp_extract(props, '"k": ([0-9]+)', 1) AS usr,
    epoch_us(ts) AS s_us,
    epoch_us(ts) + CAST(round(value * 1000) AS BIGINT) * 1000 AS e_us,
    epoch_us(ts) AS k_us, event_id AS o1, 0 AS o2, 0 AS o3 FROM events
"""
USER_LOG = f"lg AS (SELECT CAST(user_id AS VARCHAR) AS caseid, {_EVENTS})"
USER_DAY_LOG = (
    "lg AS (SELECT CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS caseid,"
    f" {_EVENTS})"
)
SHIPMENT_LOG = """
lg AS (SELECT CAST(l_orderkey AS VARCHAR) AS caseid, p_type AS task,
    CAST(l_suppkey AS VARCHAR) AS usr, epoch_us(l_shipdate) AS s_us,
    epoch_us(l_shipdate) + CAST(l_quantity AS BIGINT) * 3600000000 AS e_us,
    epoch_us(l_shipdate) AS k_us, l_linenumber AS o1, l_partkey AS o2, l_suppkey AS o3
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
ORDER_LOG = """
lg AS (SELECT CAST(o_custkey AS VARCHAR) AS caseid, o_orderstatus AS task,
    o_orderpriority AS usr, NULL::BIGINT AS s_us, epoch_us(o_orderdate) AS e_us,
    epoch_us(o_orderdate) AS k_us, o_orderkey AS o1, 0 AS o2, 0 AS o3
  FROM orders)
"""
ORD = "k_us, o1, o2, o3"

DAYTIME = "(k_us // 1000000) % 86400"
WEEKDAY = "isodow(make_timestamp(k_us)) - 1"

# Adds dur, wait, acc_cycle (seconds), daytime, weekday to lg.
TIMED = f"""
ft AS (SELECT *,
    (e_us - s_us) / 1e6 AS dur,
    greatest(coalesce(s_us - lag(e_us) OVER w, 0), 0) / 1e6 AS wait,
    (e_us - first_value(s_us) OVER w) / 1e6 AS acc_cycle,
    {DAYTIME} AS daytime, {WEEKDAY} AS weekday
  FROM lg WINDOW w AS (PARTITION BY caseid ORDER BY {ORD}))
"""
TIMED_POINT = f"""
ft AS (SELECT *,
    coalesce(e_us - lag(e_us) OVER w, 0) / 1e6 AS dur,
    (e_us - first_value(e_us) OVER w) / 1e6 AS acc_cycle,
    {DAYTIME} AS daytime, {WEEKDAY} AS weekday
  FROM lg WINDOW w AS (PARTITION BY caseid ORDER BY {ORD}))
"""


def r6(x: str, name: str | None = None) -> str:
    """Rounds to 6 digits; adding zero turns -0.0 into 0.0."""
    return f"(round({x}, 6) + 0.0) AS {name or x}"


def rnd(x: str, name: str, digits: int) -> str:
    return f"(round({x}, {digits}) + 0.0) AS {name}"


def with_(*clauses: str, select: str) -> str:
    return "WITH " + ",\n".join(clauses) + "\n" + select


# Adds a role, ac and rl codes to lg: values sorted, 1..n; start 0, end n + 1.
ROLED = """
rg AS (SELECT *, 'R' || CAST(CAST(usr AS BIGINT) % 10 AS VARCHAR) AS role FROM lg),
aci AS (SELECT task AS value, row_number() OVER (ORDER BY task) AS idx
  FROM (SELECT DISTINCT task FROM rg)),
rli AS (SELECT role AS value, row_number() OVER (ORDER BY role) AS idx
  FROM (SELECT DISTINCT role FROM rg)),
nd AS (SELECT (SELECT count(*) + 1 FROM aci) AS ac_end, (SELECT count(*) + 1 FROM rli) AS rl_end)
"""
# Timed and encoded log with the position in its case.
PREPARED = f"""
{USER_DAY_LOG},
{TIMED},
{ROLED},
en AS (SELECT ft.*, r.role, a.idx AS ac, r.idx AS rl,
    row_number() OVER (PARTITION BY caseid ORDER BY {ORD}) AS pos,
    count(*) OVER (PARTITION BY caseid) AS len
  FROM (SELECT *, 'R' || CAST(CAST(usr AS BIGINT) % 10 AS VARCHAR) AS rolename FROM ft) ft
  JOIN aci a ON ft.task = a.value
  JOIN (SELECT value AS role, idx FROM rli) r ON ft.rolename = r.role)
"""
