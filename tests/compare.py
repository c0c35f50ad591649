"""Run catalogue queries on Spark and their checking SQL on DuckDB, compare rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from corpuslens.plans import catalog  # noqa: E402
from corpuslens.session import build_session  # noqa: E402


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if hasattr(v, "as_tuple"):
        return repr(float(v))
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str):
    q = catalog.QUERIES[name]
    t0 = time.time()
    df = q.run(catalog.Tables(spark, sf_dir))
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    sql = catalog.check_sql(name)
    if sql is None:
        return True, len(got[1]), t1 - t0, 0.0, "rows only"
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if got == want:
        return True, len(got[1]), t1 - t0, t2 - t1, ""
    note = f"cols {got[0]} vs {want[0]}" if got[0] != want[0] else f"rows {len(got[1])} vs {len(want[1])}"
    diff = [(a, b) for a, b in zip(got[1], want[1]) if a != b][:3]
    return False, len(got[1]), t1 - t0, t2 - t1, f"{note}; first differences {diff}"


if __name__ == "__main__":
    sf = sys.argv[1]
    catalog.load()
    names = sys.argv[2:] or list(catalog.QUERIES)
    spark = build_session("8")
    con = connect(sf)
    bad = 0
    for n in names:
        try:
            ok, rows, a, b, note = compare(spark, con, n, sf)
        except Exception as e:  # report every query, then fail
            ok, rows, a, b, note = False, -1, 0.0, 0.0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {n:24s} rows={rows:<8d} spark={a:6.2f}s duck={b:6.2f}s {note}", flush=True)
    print("failures:", bad)
    spark.stop()
    sys.exit(bool(bad))
