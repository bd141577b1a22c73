"""Compares registered queries with their SQL, as sorted multisets of rows.

    python tests/oracle.py [--sf 0.01] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    out = []
    for row in frame.itertuples(index=False):
        out.append(tuple("<null>" if v is None or v is pd.NA or v != v else
                         (repr(float(v)) if isinstance(v, float) else str(v)) for v in row))
    return sorted(out)


def mismatch(spark_df, con, query: str) -> str | None:
    got = spark_df.toPandas()
    want = con.execute(query).df()
    # pandas holds whole numbers with nulls as floats; the types compared are the queries' own
    for name, kind in spark_df.dtypes:
        if kind in ("tinyint", "smallint", "int", "bigint"):
            got[name] = got[name].astype("Int64")
    for column in con.execute(f"DESCRIBE {query}").fetchall():
        if column[1] in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT"):
            want[column[0]] = want[column[0]].astype("Int64")
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    for c in got.columns:
        if (got[c].dtype.kind in "iu") != (want[c].dtype.kind in "iu") and len(got):
            return f"type of {c}: {got[c].dtype} != {want[c].dtype}"
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows, SQL has {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else None


def main(argv):
    import __spark_entry__ as entry
    from bench import session

    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(folder)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv or queries:
        t = time.time()
        try:
            df = queries[name](spark, folder)
            problem = mismatch(df, con, oracle[name]) if name in oracle else None
            rows = "" if name in oracle else f"(no SQL) {df.count()} rows"
        except Exception as e:  # report and go on with the next query
            problem, rows = f"{type(e).__name__}: {str(e)[:600]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - t:6.2f}s {rows} {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
