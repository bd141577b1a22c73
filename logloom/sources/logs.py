"""Reading and writing event logs: delimited files and XES."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.operators.positions import number_rows
from logloom.runtime import pin
from logloom.schema import COLUMN_NAMES, LogSchema, drop_pseudo_events

# strptime directive -> datetime pattern letters (fixed values)
_DIRECTIVES = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS",
}
STALE_COLUMNS = ("Unnamed: 0", "role")


@dataclass(frozen=True)
class ReadOptions:
    timeformat: str = "%Y-%m-%dT%H:%M:%S.%f"
    column_names: dict = field(default_factory=lambda: dict(COLUMN_NAMES))
    one_timestamp: bool = False

    @property
    def schema(self) -> LogSchema:
        return LogSchema(one_timestamp=self.one_timestamp)


def spark_pattern(timeformat: str) -> str:
    """Datetime pattern of a strptime format; other text is quoted."""
    out, i = [], 0
    while i < len(timeformat):
        directive = timeformat[i : i + 2]
        if directive in _DIRECTIVES:
            out.append(_DIRECTIVES[directive])
            i += 2
        elif timeformat[i] == "%":
            raise ValueError(f"unsupported directive {directive!r}")
        else:
            out.append(f"'{timeformat[i]}'" if timeformat[i].isalpha() else timeformat[i])
            i += 1
    return "".join(out)


def _event_key(log: DataFrame) -> DataFrame:
    """A tiebreak for events with equal order keys, from the event itself."""
    return log.withColumn("event_key", F.struct("end_timestamp", "task", "user"))


def drop_stale_columns(log: DataFrame) -> DataFrame:
    """Drops the leftovers of an exported frame, only if all of them are there."""
    return log.drop(*STALE_COLUMNS) if set(STALE_COLUMNS) <= set(log.columns) else log


def read_log(spark: SparkSession, path: str, options: ReadOptions = ReadOptions()) -> DataFrame:
    """Delimited event log with a header; values stay text, timestamps are parsed."""
    log = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=False)
    log = log.withColumnsRenamed(options.column_names)
    pattern = spark_pattern(options.timeformat)
    stamps = ["end_timestamp"] if options.one_timestamp else ["start_timestamp", "end_timestamp"]
    log = log.withColumns({c: F.to_timestamp_ntz(F.col(c), F.lit(pattern)) for c in stamps})
    return _event_key(drop_pseudo_events(drop_stale_columns(log)))


def write_log(log: DataFrame, path: str, schema: LogSchema = LogSchema()) -> None:
    """Delimited file in event order, readable by ``read_log``."""
    stamps = [c for c in ("start_timestamp", "end_timestamp") if c in log.columns]
    ordered = log.orderBy(*schema.order)
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    flat = ordered.withColumns({c: F.date_format(c, fmt) for c in stamps}).drop("event_key")
    flat.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def read_test_log(spark: SparkSession, path: str, options: ReadOptions = ReadOptions()) -> DataFrame:
    """A log written by ``write_log``, already in event-log columns."""
    return read_log(spark, path, ReadOptions(one_timestamp=options.one_timestamp, column_names={}))


def _attributes() -> list[T.StructField]:
    pair = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType())])
    return [T.StructField(tag, T.ArrayType(pair)) for tag in ("string", "date", "int", "float", "boolean")]


XES_TRACE = T.StructType(
    [*_attributes(), T.StructField("event", T.ArrayType(T.StructType(_attributes())))]
)


# An offset from UTC at the end of a time.
ZONE = r"(Z|([+-])(\d{2}):?(\d{2}))$"


def _attribute(node: str, tag: str, key: str) -> Column:
    values = F.filter(F.col(f"{node}{tag}"), lambda a: a["_key"] == key)
    return F.get(values, F.lit(0))["_value"]


def read_xes(spark: SparkSession, path: str) -> DataFrame:
    """(caseid, task, user, event_type, timestamp) rows of an XES file.

    A missing transition counts as ``complete``; times are in UTC. The file is read
    as text records that end with a trace, so a large one is read by many tasks.
    """
    records = spark.read.option("lineSep", "</trace>").text(path)
    trace = F.regexp_extract("value", r"(?s)<trace[\s>].*", 0)
    records = records.select(trace.alias("x")).where(F.col("x") != "")
    parsed = F.from_xml(F.concat("x", F.lit("</trace>")), XES_TRACE.simpleString(), {"rowTag": "trace"})
    traces = records.select(parsed.alias("t")).select("t.*")
    case = _attribute("", "string", "concept:name")
    events = traces.select(case.alias("caseid"), F.explode("event").alias("e"))
    transition = F.lower(_attribute("e.", "string", "lifecycle:transition"))
    rows = events.select(
        "caseid",
        _attribute("e.", "string", "concept:name").alias("task"),
        _attribute("e.", "string", "org:resource").alias("user"),
        F.coalesce(transition, F.lit("complete")).alias("event_type"),
        _attribute("e.", "date", "time:timestamp").alias("_given"),
    )
    # each attribute is looked for, and each time matched, once
    rows = rows.withColumn("_zone", F.regexp_extract("_given", ZONE, 0))
    stamp = F.substring("_given", F.lit(1), F.length("_given") - F.length("_zone"))
    sign = F.when(F.startswith("_zone", F.lit("-")), -1).otherwise(1)
    hours = F.coalesce(F.substring("_zone", 2, 2).try_cast("int"), F.lit(0))
    minutes = F.coalesce(F.substring("_zone", -2, 2).try_cast("int"), F.lit(0))
    offset = F.make_dt_interval(mins=sign * (hours * 60 + minutes))
    return rows.select(
        "caseid", "task", "user", "event_type",
        (F.to_timestamp_ntz(stamp, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")) - offset).alias("timestamp"),
    )


def pair_lifecycle(rows: DataFrame) -> DataFrame:
    """Interval events from ``start`` and ``complete`` rows.

    Within (case, task, user) the k-th start belongs to the k-th complete; a
    row without partner is an instant event. The rows are pinned, as they are counted
    before they are numbered and may come from parsed text.
    """
    by = ["caseid", "task", "user", "event_type"]
    rows = pin(rows.where(F.col("event_type").isin("start", "complete")).select(*by, "timestamp"))
    placed = number_rows(rows, by, ["timestamp"], "_k")
    # A pair shares (case, task, user, k): two rows per group, whatever the case.
    stamp = {t: F.max(F.when(F.col("event_type") == t, F.col("timestamp"))) for t in ("start", "complete")}
    paired = placed.groupBy("caseid", "task", "user", "_k").agg(
        F.coalesce(stamp["start"], stamp["complete"]).alias("start_timestamp"),
        F.coalesce(stamp["complete"], stamp["start"]).alias("end_timestamp"),
    )
    return _event_key(drop_pseudo_events(paired.drop("_k")))


def complete_events(rows: DataFrame) -> DataFrame:
    """Point events: the ``complete`` rows."""
    done = rows.where("event_type = 'complete'").withColumnRenamed("timestamp", "end_timestamp")
    return _event_key(drop_pseudo_events(done))
