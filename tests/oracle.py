"""Runs every query in Spark and DuckDB and compares the rows. Also a script: oracle.py [folder] [names...]"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(v)) for v in row)


def spark_rows(df):
    names = sorted(df.columns)
    rows = [tuple(r) for r in df.select([df[f"`{c}`"] for c in names]).collect()]
    return names, sorted(rows, key=_key)


def duck_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    names = [rel.columns[i] for i in order]
    rows = [tuple(r[i] for i in order) for r in con.execute(sql).fetchall()]
    return names, sorted(rows, key=_key), [str(rel.types[i]) for i in order]


def differences(spark, con, folder: str, name: str) -> str:
    df = entry.queries()[name](spark, folder)
    names, got = spark_rows(df)
    wanted_names, wanted, _ = duck_rows(con, entry.oracle_sql()[name])
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"{len(got)} rows != {len(wanted)}"
    bad = [(a, b) for a, b in zip(got, wanted) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    from demandloom.session import get_session

    where = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = database(where)
    failed = 0
    for query in sys.argv[2:] or entry.queries():
        began = time.time()
        try:
            if query in entry.oracle_sql():
                result = differences(spark, con, where, query)
            else:
                result = f"(no SQL) {len(entry.queries()[query](spark, where).collect())} rows"
        except Exception as error:  # report every query, then go on
            result = f"ERROR {str(error)[:600]}"
        failed += bool(result) and not result.startswith("(no SQL)")
        print(f"{query:32s} {time.time() - began:6.2f}s {result[:900] or 'ok'}", flush=True)
    print("failed:", failed)
