"""Registered queries: trace series and samples."""

from pyspark.sql import functions as F

from logloom.catalog import sql as S
from logloom.catalog.common import INTERVAL, big, prepared, text
from logloom.functions.arrays import one_hot, pad_last
from logloom.functions.scaling import scale_features
from logloom.operators import samples as ops
from logloom.operators.encode import build_index, encode
from logloom.operators.features import sample_columns
from logloom.schema import LogSchema
from logloom.sources.adapters import dialogue_log

BASE = sample_columns(INTERVAL)
EXTRA = sample_columns(INTERVAL, ["daytime", "weekday"])
DIGITS = {"dur_norm": 6, "wait_norm": 6, "daytime_norm": 7}
WHOLE = ("ac_index", "rl_index", "weekday")


def _scaled(spark, folder, profile, extra=()):
    log, activities, roles, ends = prepared(spark, folder)
    log, _ = scale_features(log, profile, INTERVAL, "lognorm", extra)
    return log, ends


def _flat(samples, columns, second):
    """Arrays as text and labels as numbers, for comparison."""
    out = ["caseid", big("cut")]
    for c in columns:
        out.append(text(f"{c}_prefix", DIGITS.get(c)))
        if second == "suffix":
            out.append(text(f"{c}_suffix", DIGITS.get(c)))
        elif c in WHOLE:
            out.append(big(f"{c}_next"))
        else:
            out.append(F.round(f"{c}_next", DIGITS[c]).alias(f"{c}_next"))
    return samples.select(*out)


def trace_series(spark, folder):
    log, ends = _scaled(spark, folder, "inter", ["daytime", "weekday"])
    traces = ops.to_traces(log, EXTRA, ends)
    return traces.select("caseid", big("part"), *[text(c, DIGITS.get(c)) for c in EXTRA])


def ngrams_5(spark, folder):
    log, ends = _scaled(spark, folder, "basic")
    return _flat(ops.ngram_samples(log, BASE, 5, ends), BASE, "next")


def ngrams_context(spark, folder):
    log, ends = _scaled(spark, folder, "inter", ["daytime", "weekday"])
    return _flat(ops.ngram_samples(log, EXTRA, 3, ends), EXTRA, "next")


def next_events(spark, folder):
    log, ends = _scaled(spark, folder, "basic")
    return _flat(ops.next_event_samples(log, BASE, ends), BASE, "next")


def next_events_context(spark, folder):
    log, ends = _scaled(spark, folder, "inter", ["daytime", "weekday"])
    return _flat(ops.next_event_samples(log, EXTRA, ends), EXTRA, "next")


def suffixes(spark, folder):
    log, ends = _scaled(spark, folder, "basic")
    return _flat(ops.suffix_samples(log, BASE, ends), BASE, "suffix")


def suffixes_context(spark, folder):
    log, ends = _scaled(spark, folder, "inter", ["daytime", "weekday"])
    return _flat(ops.suffix_samples(log, EXTRA, ends), EXTRA, "suffix")


def padded(spark, folder):
    log, _, _, ends = prepared(spark, folder)
    samples = ops.next_event_samples(log, ["ac_index"], ends)
    window = pad_last(F.col("ac_index_prefix"), 3, F.lit(0))
    return samples.select("caseid", big("cut"), text(window, name="window"))


def one_hot_weekday(spark, folder):
    log, _, _, _ = prepared(spark, folder)
    return log.select(big("event_key", "event_id"), text(one_hot(F.col("weekday"), 7), name="bits"))


def tensors(spark, folder):
    """Stacked features of each sample, weekday one-hot last."""
    log, ends = _scaled(spark, folder, "inter", ["daytime", "weekday"])
    columns = ["dur_norm", "daytime_norm", "weekday"]
    samples = ops.ngram_samples(log, columns, 2, {})
    samples = ops.stack_features(samples, columns)
    steps = F.transform("tensor", lambda s: F.concat_ws(
        ",", F.format_string("%.6f", s[0]), F.format_string("%.7f", s[1]),
        F.slice(s, 3, 7).cast("array<int>").cast("array<string>")))
    return samples.select("caseid", big("cut"), F.array_join(steps, ";").alias("tensor"))


def dialogue_ngrams(spark, folder):
    """Control flow only: the last three speakers before each turn and the end."""
    log = dialogue_log(spark, folder)
    index = build_index(log, "task")
    log = encode(log, index, "task", "ac_index").withColumn("start_timestamp", F.col("event_key"))
    rows = ops.ngram_samples(log, ["ac_index"], 3, {"ac_index": index.end}, LogSchema())
    return rows.select("caseid", big("cut"), text("ac_index_prefix"), big("ac_index_next"))


# Per case: the sequences with sentinels, numbers as text of fixed digits.
_NORMED = f"""{S.PREPARED},
st AS (SELECT min(ln(1 + dur)) AS dlo, max(ln(1 + dur)) AS dhi,
  min(ln(1 + wait)) AS wlo, max(ln(1 + wait)) AS whi FROM en),
sq AS (SELECT caseid, any_value(len) AS len,
    ['0'] || list(CAST(ac AS VARCHAR) ORDER BY pos) || [CAST(any_value(ac_end) AS VARCHAR)] AS ac_index,
    ['0'] || list(CAST(rl AS VARCHAR) ORDER BY pos) || [CAST(any_value(rl_end) AS VARCHAR)] AS rl_index,
    ['0.000000'] || list(printf('%.6f', (ln(1 + dur) - dlo) / (dhi - dlo)) ORDER BY pos) || ['0.000000'] AS dur_norm,
    ['0.000000'] || list(printf('%.6f', (ln(1 + wait) - wlo) / (whi - wlo)) ORDER BY pos) || ['0.000000'] AS wait_norm,
    ['0.0000000'] || list(printf('%.7f', daytime / 86400.0) ORDER BY pos) || ['0.0000000'] AS daytime_norm,
    ['0'] || list(CAST(weekday AS VARCHAR) ORDER BY pos) || ['0'] AS weekday
  FROM en, nd, st GROUP BY caseid)
"""
_ZERO = {"dur_norm": "0.000000", "wait_norm": "0.000000", "daytime_norm": "0.0000000"}


def _sql(columns, n=None, second="next", top="len"):
    """Samples of cuts 0..top; windows of n values, or whole prefixes."""
    out = []
    for c in columns:
        if n:
            zeros = "[" + ", ".join([f"'{_ZERO.get(c, '0')}'"] * n) + "]"
            prefix = f"({zeros} || {c})[cut + 2 : cut + 1 + {n}]"
        else:
            prefix = f"{c}[1 : cut + 1]"
        out.append(f"array_to_string({prefix}, ',') AS {c}_prefix")
        if second == "suffix":
            out.append(f"array_to_string({c}[cut + 2 : len + 2], ',') AS {c}_suffix")
        else:
            kind = "BIGINT" if c in WHOLE else "DOUBLE"
            out.append(f"CAST({c}[cut + 2] AS {kind}) AS {c}_next")
    return S.with_(_NORMED, select=f"""
        SELECT caseid, cut, {", ".join(out)} FROM sq, LATERAL (SELECT unnest(range({top} + 1)) AS cut)""")


QUERIES = {
    "trace_series": (
        trace_series,
        S.with_(_NORMED, select="SELECT caseid, CAST(0 AS BIGINT) AS part, "
            + ", ".join(f"array_to_string({c}, ',') AS {c}" for c in EXTRA) + " FROM sq"),
    ),
    "ngram_samples_5": (ngrams_5, _sql(BASE, 5)),
    "ngram_samples_ctx": (ngrams_context, _sql(EXTRA, 3)),
    "next_event_samples": (next_events, _sql(BASE, top="len - 1")),
    "next_event_samples_ctx": (next_events_context, _sql(EXTRA, top="len - 1")),
    "suffix_samples": (suffixes, _sql(BASE, second="suffix")),
    "suffix_samples_ctx": (suffixes_context, _sql(EXTRA, second="suffix")),
    "pad_last": (
        padded,
        S.with_(_NORMED, select="""
            SELECT caseid, cut,
              array_to_string((['0', '0', '0'] || ac_index)[cut + 2 : cut + 4], ',') AS "window"
            FROM sq, LATERAL (SELECT unnest(range(len)) AS cut)"""),
    ),
    "onehot_weekday": (
        one_hot_weekday,
        S.with_(S.PREPARED, select="""
            SELECT o1 AS event_id, array_to_string(
              list_transform(range(7), lambda i: CASE WHEN i = weekday THEN 1 ELSE 0 END), ',') AS bits
            FROM en"""),
    ),
    "stacked_features": (
        tensors,
        S.with_(_NORMED, """
st2 AS (SELECT caseid, len,
  ['0.000000'] || dur_norm AS d, ['0.0000000'] || daytime_norm AS t, ['0'] || weekday AS w FROM sq)
""", select="""
            SELECT caseid, cut, array_to_string(list_transform([1, 2], lambda j: concat(
                d[cut + j], ',', t[cut + j], ',', array_to_string(list_transform(range(7),
                  lambda i: CASE WHEN CAST(i AS VARCHAR) = w[cut + j] THEN 1 ELSE 0 END), ','))), ';')
              AS tensor
            FROM st2, LATERAL (SELECT unnest(range(len + 1)) AS cut)"""),
    ),
    "dialogue_ngrams": (
        dialogue_ngrams,
        """
WITH ix AS (SELECT role, row_number() OVER (ORDER BY role) AS idx
  FROM (SELECT DISTINCT role FROM conversations)),
sq AS (SELECT conv_id, count(*) AS len, [0, 0, 0, 0] || list(idx ORDER BY turn)
    || [(SELECT count(*) + 1 FROM ix)] AS s
  FROM conversations JOIN ix USING (role) GROUP BY conv_id)
SELECT CAST(conv_id AS VARCHAR) AS caseid, cut,
  array_to_string(s[cut + 2 : cut + 4], ',') AS ac_index_prefix, s[cut + 5] AS ac_index_next
FROM sq, LATERAL (SELECT unnest(range(len + 1)) AS cut)""",
    ),
}
