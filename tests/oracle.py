"""Compare registered queries with their SQL: python tests/oracle.py sf_dir [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 10**8 else str(v)
    return repr(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def compare(spark, con, sf_dir, fn, sql):
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, first {str(bad[0])[:600]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries

    from pairloom.session import builder

    spark = builder("oracle", "local[8]").config("spark.sql.shuffle.partitions", "8").config(
        "spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in sys.argv[2:] or qs:
        t = time.time()
        try:
            out = compare(spark, con, sys.argv[1], qs[name], sqls[name]) if name in sqls else f"{qs[name](spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            out = f"FAILED {type(e).__name__}: {str(e)[:700]}"
        bad += bool(out) and "no SQL" not in out
        print(f"{name:34s} {time.time() - t:6.1f}s {out or 'ok'}", flush=True)
    print(f"{bad} of {len(sys.argv[2:] or qs)} differ")
