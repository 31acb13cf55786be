"""Run a query key in Spark and its oracle SQL in DuckDB; compare the results.

Comparison: same column names, same row count, same multiset of rows with
columns in name order. Doubles are compared exactly unless ``digits`` is set.

CLI: python tests/oracle_compare.py [--sf DIR] [key ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def _norm(v, digits):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, digits) if digits is not None else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return v


def _canon(cols, rows, digits):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    out.sort(key=repr)
    return [cols[i] for i in order], out


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    rel = con.sql(sql)
    return list(rel.columns), rel.fetchall()


def spark_result(df):
    rows = df.collect()
    return list(df.columns), [tuple(r) for r in rows]


def compare(spark, key: str, sf_dir: str, digits=None):
    import __spark_entry__ as entry
    df = entry.queries()[key](spark, sf_dir)
    s_cols, s_rows = spark_result(df)
    sql = entry.oracle_sql().get(key)
    if sql is None:
        return {"key": key, "rows": len(s_rows), "oracle": None}
    d_cols, d_rows = duck(sf_dir, sql)
    sc, sr = _canon(s_cols, s_rows, digits)
    dc, dr = _canon(d_cols, d_rows, digits)
    res = {"key": key, "rows": len(sr), "oracle_rows": len(dr),
           "columns_match": sc == dc, "values_match": sr == dr}
    if not res["columns_match"]:
        res["spark_cols"], res["oracle_cols"] = sc, dc
    elif not res["values_match"]:
        only_s = [r for r in sr if r not in set(dr)][:3]
        only_d = [r for r in dr if r not in set(sr)][:3]
        res["spark_only"], res["oracle_only"] = only_s, only_d
    return res


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    args = ap.parse_args()
    from cellpulse.session import build_session
    import __spark_entry__ as entry
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    keys = args.keys or list(entry.queries())
    bad = 0
    for k in keys:
        t = time.time()
        try:
            r = compare(spark, k, args.sf)
        except Exception as e:  # report and go on with the other keys
            r = {"key": k, "error": repr(e)[:400]}
        r["sec"] = round(time.time() - t, 2)
        ok = r.get("oracle") is None and "error" not in r and "values_match" not in r
        ok = ok or (r.get("columns_match") and r.get("values_match"))
        bad += not ok
        print(("OK  " if ok else "BAD ") + repr(r), flush=True)
    print(f"{len(keys) - bad}/{len(keys)} ok")


if __name__ == "__main__":
    main()
