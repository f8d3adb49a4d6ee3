"""Compare registered queries with their SQL on one data folder. Usage: python tests/compare.py DIR [names...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.sql(f"create view {name} as select * from '{path}'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    """Returns (ok, message)."""
    t = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - t
    if sql is None:
        return True, f"{spent:5.1f}s rows={len(got)} (no SQL)"
    t = time.time()
    res = con.sql(sql)
    want_cols, want_types = res.columns, [str(x) for x in res.types]
    want = res.fetchall()
    took = time.time() - t
    names, mine = rows_of(cols, got)
    other, theirs = rows_of(want_cols, want)
    info = f"{spent:5.1f}s/{took:4.1f}s rows={len(mine)}"
    odd = [t for t in want_types if t not in ("BIGINT", "INTEGER", "DOUBLE", "VARCHAR", "BOOLEAN")]
    if names != other:
        return False, f"{info} COLUMNS {names} vs {other}"
    if odd:
        return False, f"{info} TYPES {dict(zip(want_cols, want_types))}"
    if len(mine) != len(theirs):
        return False, f"{info} ROWS {len(mine)} vs {len(theirs)}"
    if mine != theirs:
        diff = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return False, f"{info} VALUES {len(diff)} differ {names}\n   spark {diff[0][0]}\n   sql   {diff[0][1]}"
    return True, info


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", os.environ.get("COMPARE_PARTITIONS", "8"))
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, text = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{type(e).__name__} {str(e)[:600]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, text, flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
