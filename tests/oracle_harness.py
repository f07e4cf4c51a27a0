"""Spark-vs-DuckDB comparison of registered queries (our stand-in for the
driver's correctness gate): column names, types, row count and the exact
multiset of row values.

CLI: ``python tests/oracle_harness.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

SPARK_TO_DUCK = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "date": "DATE", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(spark, con, name: str, sf_dir: str) -> dict:
    from obol.plans.queries import QUERIES
    from obol.plans.oracle_sql import ORACLE
    t0 = time.time()
    sdf = QUERIES[name](spark, sf_dir)
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    s_rows = [tuple(_norm(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if name not in ORACLE:
        res["status"] = "rows-only"
        return res
    rel = con.sql(ORACLE[name])
    d_cols = rel.columns
    d_types = {c: str(t) for c, t in zip(d_cols, rel.types)}
    d_raw = rel.fetchall()
    idx = {c: i for i, c in enumerate(d_cols)}
    d_rows = [tuple(_norm(r[idx[c]]) for c in sorted(d_cols)) for r in d_raw]
    res["duck_rows"] = len(d_rows)
    problems = []
    if sorted(sdf.columns) != sorted(d_cols):
        problems.append(f"columns differ: spark-only={sorted(set(sdf.columns) - set(d_cols))} "
                        f"duck-only={sorted(set(d_cols) - set(sdf.columns))}")
    else:
        for c in sdf.columns:
            want = SPARK_TO_DUCK.get(s_types[c], s_types[c].upper())
            if want != d_types[c]:
                problems.append(f"type {c}: spark {s_types[c]} vs duck {d_types[c]}")
        if len(s_rows) != len(d_rows):
            problems.append(f"row count {len(s_rows)} vs {len(d_rows)}")
        cs, cd = Counter(s_rows), Counter(d_rows)
        if cs != cd:
            only_s = list((cs - cd).elements())[:3]
            only_d = list((cd - cs).elements())[:3]
            problems.append(f"values differ; cols={sorted(sdf.columns)}\n  spark-only {only_s}\n  duck-only  {only_d}")
    res["status"] = "ok" if not problems else "MISMATCH"
    res["problems"] = problems
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from obol.session import local_session
    from obol.plans.queries import QUERIES
    spark = local_session(8)
    con = duck_connect(sf_dir)
    bad = 0
    for name in names or list(QUERIES):
        try:
            r = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and continue
            r = {"name": name, "status": "ERROR", "problems": [repr(e)[:2000]]}
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(f"{r['status']:9s} {name:32s} rows={r.get('spark_rows')}/{r.get('duck_rows')} "
              f"t={r.get('spark_sec')}", flush=True)
        for p in r.get("problems", []):
            print("    ", p, flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
