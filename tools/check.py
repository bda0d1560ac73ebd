"""Compare registered queries with their SQL on DuckDB: rows, columns and values.

    python tools/check.py [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sessionloom import plans  # noqa: E402
from sessionloom.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(root: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if v is not None and not isinstance(v, (int, str, bool)):
        return str(v)
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda t: tuple(("" if x is None else str(x)) for x in t))
    return [names[i] for i in order], out


def compare(spark, con, name, root, spark_root=None):
    """``spark_root``: where Spark finds the same tables in another layout."""
    fn, sql = plans.queries()[name], plans.oracle_sql().get(name)
    t = time.time()
    df = fn(spark, spark_root or root)
    sc, sr = table(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return (len(sr) > 0 and "rows" or "EMPTY"), f"{len(sr)} rows", took
    res = con.execute(sql)
    dc, dr = table([d[0] for d in res.description], res.fetchall())
    if sc != dc:
        return "COLS", f"{sc} vs {dc}", took
    if len(sr) != len(dr):
        a, b = set(sr), set(dr)
        return "COUNT", f"{len(sr)} vs {len(dr)}; spark-only {list(a - b)[:2]} sql-only {list(b - a)[:2]}", took
    bad = [(x, y) for x, y in zip(sr, dr) if x != y]
    if bad:
        return "VALUES", f"{len(bad)}/{len(sr)} cols {sc}: {bad[0][0]} vs {bad[0][1]}", took
    return ("ok" if sr else "EMPTY"), f"{len(sr)} rows", took


def main(argv):
    root = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = build_session("check", f"local[{os.environ.get('CHECK_CPUS', '8')}]",
                          **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    names = [n for n in plans.queries() if not argv or any(n.startswith(a) for a in argv)]
    failed = 0
    for n in names:
        try:
            status, note, took = compare(spark, con, n, root)
        except Exception as e:  # report and go on with the next query
            status, note, took = "ERROR", f"{type(e).__name__}: {str(e)[:600]}", 0.0
        if status not in ("ok", "rows"):
            failed += 1
        if status not in ("ok", "rows") or os.environ.get("CHECK_VERBOSE"):
            print(f"{status:7s} {n:36s} {took:6.1f}s {note}", flush=True)
    print(f"{len(names)} checked, {failed} bad", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
