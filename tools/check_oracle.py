"""Run registered queries on Spark and their SQL oracles on DuckDB; compare.

usage: python tools/check_oracle.py [--sf DIR] [--update-types] [name-prefix ...]

Compares row count, column names and the order-insensitive multiset of rows
(values rendered canonically).  With --update-types the Spark output schema
of each query is recorded in veldt/plans/oracle_types.json so the oracle's
final projection applies the same normalisation.
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import json
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from veldt.plans import catalog, registry  # noqa: E402
from veldt.session import get_spark  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        return repr(round(v, 6) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 6) + 0.0)
    if isinstance(v, (datetime.datetime,)):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{canon(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return canon(v.asDict())
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--update-types", action="store_true")
    ap.add_argument("--tz", default=None, help="session time zone to simulate a foreign driver session")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    catalog.load_all()
    spark = get_spark("local[8]", 8, extra={"spark.ui.showConsoleProgress": "false"})
    if a.tz:
        spark.conf.set("spark.sql.session.timeZone", a.tz)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    names = [n for n in registry.QUERIES if not a.names or any(n.startswith(p) for p in a.names)]
    types = registry.load_types()
    results = {}
    for n in names:
        t0 = time.time()
        try:
            sdf = registry.QUERIES[n](spark, a.sf)
            scols = sdf.columns
            if a.update_types:
                types[n] = registry.column_kinds(sdf)
            srows = [tuple(r) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{n}: SPARK ERROR {type(e).__name__}: {str(e)[:400]}".replace("\n", " "))
            results[n] = "spark_error"
            continue
        ts = time.time() - t0
        if n not in registry.ORACLES:
            print(f"{n}: rows={len(srows)} (no oracle: {registry.NO_ORACLE.get(n, '?')}) {ts:.1f}s")
            results[n] = "rows_only"
            continue
        sql = registry.wrap_sql(n, registry.ORACLES[n], types)
        try:
            cur = con.execute(sql)
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{n}: DUCKDB ERROR {str(e)[:600]}")
            results[n] = "duck_error"
            continue
        ok_cols = sorted(scols) == sorted(dcols)
        ok_n = len(srows) == len(drows)
        sr, dr = rows_of(scols, srows), rows_of(dcols, drows)
        ok_v = ok_cols and sr == dr
        status = "OK" if (ok_cols and ok_n and ok_v) else "MISMATCH"
        results[n] = status
        print(f"{n}: {status} rows spark={len(srows)} duck={len(drows)} cols_ok={ok_cols} {ts:.1f}s")
        if status != "OK":
            if not ok_cols:
                print("   spark cols", sorted(scols), "\n   duck cols ", sorted(dcols))
            else:
                ss, ds = set(sr), set(dr)
                print("   only spark:", str(list(ss - ds)[:2])[:600])
                print("   only duck :", str(list(ds - ss)[:2])[:600])
    if a.update_types:
        with open(registry._TYPES_FILE, "w") as fh:
            json.dump(types, fh, indent=0, sort_keys=True)
    bad = [k for k, v in results.items() if v not in ("OK", "rows_only")]
    print(f"\n{len(results) - len(bad)}/{len(results)} ok; bad: {bad}")


if __name__ == "__main__":
    main()
