"""Runs registered queries beside their SQL on the same tables and compares the results."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import signal
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, (int, float)):
        v = float(v)
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir) -> str | None:
    """None when both agree, else what differs."""
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first spark {got[:1]} sql {want[:1]}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, e.g. {got_cols} {bad[0][0]} != {bad[0][1]}" if bad else None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()

    def too_long(*_):
        raise TimeoutError("took too long")

    signal.signal(signal.SIGALRM, too_long)
    wanted = sys.argv[1:]
    for name, query in queries.items():
        if wanted and not any(name == w or name.startswith(w + "_") or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        signal.alarm(int(os.environ.get("QUERY_LIMIT", "40")))
        try:
            if name in oracle:
                problem = compare(spark, con, query, oracle[name], sf_dir)
                status = "ok" if problem is None else "DIFF " + problem[:700]
            else:
                status = f"rows {query(spark, sf_dir).count()}"
        except Exception as exc:  # noqa: BLE001
            status = "FAIL " + str(exc)[:900].replace("\n", " | ")
        signal.alarm(0)
        if "took too long" in status:
            spark.sparkContext.cancelAllJobs()
        print(f"{name:34s} {time.time() - start:6.1f}s {status}", flush=True)


if __name__ == "__main__":
    main()
