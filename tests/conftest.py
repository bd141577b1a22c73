import sys
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from helpers import T0  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "2")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    yield session
    session.stop()


LOG = (
    "caseid string, task string, user string, start_timestamp timestamp_ntz, "
    "end_timestamp timestamp_ntz, event_key bigint"
)


@pytest.fixture(scope="session")
def make_log(spark):
    """Log from (case, task, user, start second, end second) rows."""

    def build(rows):
        at = [T0 + timedelta(seconds=0)]
        data = [
            (c, t, u, at[0] + timedelta(seconds=s), at[0] + timedelta(seconds=e), i)
            for i, (c, t, u, s, e) in enumerate(rows)
        ]
        return spark.createDataFrame(data, LOG)

    return build


@pytest.fixture(scope="session")
def tiny_log(make_log):
    """Two cases, five events, one overlap."""
    return make_log(
        [
            ("c1", "A", "u1", 0, 10),
            ("c1", "B", "u2", 15, 30),
            ("c1", "C", "u1", 20, 50),  # starts before B ends
            ("c2", "A", "u1", 5, 5),
            ("c2", "C", "AUTO", 65, 70),
        ]
    )


@pytest.fixture(scope="session")
def skewed_log(make_log):
    """One case holds a third of 360 events; starts are tied in pairs."""
    rows = []
    for i in range(120):
        rows.append(("hot", "ABCDE"[i * i % 5], f"u{i % 3}", 10 * (i // 2), 10 * (i // 2) + i % 7))
    for i in range(240):
        rows.append((f"c{i % 60}", "ABCDE"[i * 7 % 5], f"u{i % 4}", 3 * i, 3 * i + i % 5))
    return make_log(rows)


@pytest.fixture
def split_hot(monkeypatch):
    """Makes groups of more than 50 rows hot, with segments of 16 rows."""
    from logloom.operators import positions

    monkeypatch.setattr(positions, "HOT_ROWS", 50)
    monkeypatch.setattr(positions, "SEGMENT_ROWS", 16)
