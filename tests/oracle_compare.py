"""Compare a registered Spark query with its DuckDB oracle on the same tables.

Columns are compared by name (sorted), rows as an unordered multiset after
normalising values (floats to 9 significant digits, numpy scalars to Python).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}")
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, name, fn, sql, sf_dir, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    info = {"name": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows),
            "spark_sec": round(t1 - t0, 2), "duck_sec": round(t2 - t1, 2)}
    if sorted(s_cols) != sorted(d_cols):
        info["ok"] = False
        info["why"] = f"columns differ: {sorted(s_cols)} vs {sorted(d_cols)}"
        return info
    a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
    info["ok"] = a == b
    if not info["ok"]:
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        info["why"] = f"values differ; spark-only {diff_a} duck-only {diff_b} (cols {sorted(s_cols)})"
    return info


def main(argv):
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from keyedit.session import get_session
    import __spark_entry__ as e
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    spark = get_session(master="local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            r = fn(spark, sf_dir).count()
            print(f"{name:28s} rows-only {r}")
            continue
        try:
            info = compare(spark, name, fn, sqls[name], sf_dir, con)
        except Exception as exc:  # report and go on
            info = {"name": name, "ok": False, "why": f"{type(exc).__name__}: {str(exc)[:400]}"}
        bad += not info["ok"]
        print(f"{name:28s} {'OK ' if info['ok'] else 'BAD'} {info.get('spark_rows')} {info.get('duck_rows')} "
              f"{info.get('spark_sec')}s {info.get('why', '')}", flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
