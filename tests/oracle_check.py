"""Run registered queries with Spark and their DuckDB twins; compare rows, columns, values.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import json
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm_value(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{round(v, 6) + 0.0:.6f}"
    if hasattr(v, "as_tuple"):  # Decimal
        return f"{round(float(v), 6) + 0.0:.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm_value(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm_value(v[k])}" for k in sorted(v)) + "}"
    if v is None:
        return "NULL"
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = sorted(tuple(norm_value(r[i]) for i in order) for r in rows)
    return [cols[i] for i in order], out


def compare(spark, sf_dir, names=None, verbose=True):
    import __spark_entry__ as E
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in (names or list(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            results[name] = {"ok": False, "error": f"spark: {type(e).__name__}: {str(e)[:300]}"}
            if verbose:
                print(name, results[name], flush=True)
            continue
        ts = time.time() - t0
        if name not in sqls:
            results[name] = {"ok": None, "rows": len(srows), "spark_s": round(ts, 2)}
            if verbose:
                print(name, results[name], flush=True)
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            results[name] = {"ok": False, "error": f"duckdb: {str(e)[:300]}"}
            if verbose:
                print(name, results[name], flush=True)
            continue
        c1, v1 = canon(scols, srows)
        c2, v2 = canon(dcols, drows)
        ok = c1 == c2 and v1 == v2
        res = {"ok": ok, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(ts, 2)}
        if not ok:
            res["cols"] = (c1, c2) if c1 != c2 else c1
            diff1 = [r for r in v1 if r not in set(v2)][:3]
            diff2 = [r for r in v2 if r not in set(v1)][:3]
            res["spark_only"] = diff1
            res["oracle_only"] = diff2
        results[name] = res
        if verbose:
            print(name, json.dumps(res, default=str)[:1500], flush=True)
    return results


if __name__ == "__main__":
    from lineagelab.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or None
    spark = build_session("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, names)
    bad = [k for k, v in res.items() if v.get("ok") is False]
    print("SUMMARY", len(res), "queries;", sum(1 for v in res.values() if v.get("ok")), "match;",
          "failing:", bad)
