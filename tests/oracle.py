"""Run queries beside their SQL: python tests/oracle.py SF_DIR [NAME...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("+00:00", "")
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}" if v != int(v) else str(int(v))
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(_cell(r[i]) for i in order) for r in rows], key=repr)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = p + "/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{at}')")
    return con


def compare(spark, con, sf_dir, f, sql):
    df = f(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got)
    if got != want:
        a, b = set(map(repr, got)) - set(map(repr, want)), set(map(repr, want)) - set(map(repr, got))
        return f"{len(got)} rows, SQL {len(want)}; only here {sorted(a)[:2]}; only SQL {sorted(b)[:2]}", len(got)
    return "", len(got)


if __name__ == "__main__":
    import __spark_entry__ as E
    from archivolt.session import build_session

    sf, only = sys.argv[1], sys.argv[2:]
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = duck(sf), E.oracle_sql()
    bad = 0
    for name, f in E.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            said, n = compare(spark, con, sf, f, sql[name]) if name in sql else ("", f(spark, sf).count())
        except Exception as e:  # noqa: BLE001
            said, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        bad += bool(said)
        print(f"{'BAD' if said else 'ok' if name in sql else 'rows'} {name} {n} rows {time.time() - t:.1f} s {said}", flush=True)
    sys.exit(bad > 0)
