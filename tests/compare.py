"""Run registered queries on Spark and their SQL on DuckDB, and compare names, row counts and values."""

from __future__ import annotations

import math
import os
import sys
import time

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()


def session(cores: str = "8"):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("flickpulse")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    key = lambda r: tuple((x is not None, str(type(x)), x) for x in r)
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=key)


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return True, f"{len(got[1])} rows, no SQL", took
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} / {want[0]}", took
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} / {len(want[1])}", took
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return False, f"{len(bad)} of {len(got[1])} rows differ, first {got[0]}\n   spark {bad[0][0]}\n   sql   {bad[0][1]}", took
    return True, f"{len(got[1])} rows", took


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    sf = os.environ.get("SF", "0.01")
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), duck(sf_dir)
    qs, os_ = e.queries(), e.oracle_sql()
    keys = [k for k in qs if not argv or any(k == a or (a.endswith("*") and k.startswith(a[:-1])) for a in argv)]
    fails = 0
    for k in keys:
        try:
            ok, msg, took = compare(spark, con, k, qs[k], os_.get(k), sf_dir)
        except Exception as ex:  # noqa: BLE001
            ok, msg, took = False, f"{type(ex).__name__}: {str(ex)[:700]}", 0
        fails += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {k}: {msg}", flush=True)
    print(f"{len(keys)} queries, {fails} failed")


if __name__ == "__main__":
    main(sys.argv[1:])
