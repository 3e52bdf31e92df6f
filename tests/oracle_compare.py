"""Compare registered queries with their DuckDB twins: `python tests/oracle_compare.py [sf_dir] [names]`."""

from __future__ import annotations

import os
import sys
import threading
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


LIMIT_S = float(os.environ.get("QUERY_LIMIT_S", "40"))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted text tuples over sorted columns; floats rounded, missing values alike."""
    def cell(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "∅"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.6f}"
        return str(v)

    df = df[sorted(df.columns)]
    return sorted(tuple(cell(v) for v in row) for row in df.astype(object).itertuples(index=False))


def compare(spark, con, name, fn, sql, sf_dir) -> tuple[bool, str, float]:
    start = time.time()
    got = fn(spark, sf_dir).toPandas()
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no twin", took
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} / {sorted(want.columns)}", took
    a, b = normal(got), normal(want)
    if a == b:
        return True, f"{len(a)} rows", took
    only_a = [x for x in a if x not in set(b)][:2]
    only_b = [x for x in b if x not in set(a)][:2]
    return False, f"rows {len(a)} / {len(b)}\n   spark {only_a}\n   duck  {only_b}", took


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and name not in wanted:
            continue
        timer = threading.Timer(LIMIT_S, spark.sparkContext.cancelAllJobs)
        timer.start()
        try:
            ok, note, took = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            ok, note, took = False, "".join(traceback.format_exception_only(exc))[:700], 0.0
        timer.cancel()
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
