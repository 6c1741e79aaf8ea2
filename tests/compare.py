"""Runs queries and their SQL on the same folder and compares rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from loomgraph.tables import NAMES  # noqa: E402


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(row[i]) for i in order) for row in rows)


def duck(folder):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in NAMES:
        path = Path(folder, f"{name}.parquet")
        if path.exists():
            con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def compare(spark, con, folder, name, query, sql):
    began = time.time()
    df = query(spark, folder)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - began
    cursor = con.execute(sql)
    theirs = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    text = f"{name}: {sum(mine[1].values())} rows, {took:.1f} s"
    if mine[0] != theirs[0]:
        return False, f"{text}; columns {mine[0]} against {theirs[0]}"
    if mine[1] != theirs[1]:
        more, less = list((mine[1] - theirs[1]).items()), list((theirs[1] - mine[1]).items())
        return False, f"{text}; {len(more)} rows only here, e.g. {more[:2]}; {len(less)} only in SQL, e.g. {less[:2]}"
    return True, text


if __name__ == "__main__":
    import __spark_entry__
    from loomgraph.session import build_session

    folder = sys.argv[1]
    names = sys.argv[2:]
    spark, con = build_session(**{"spark.driver.memory": "8g"}), duck(folder)
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in names or sorted(queries):
        if name not in sql:
            began = time.time()
            try:
                n = queries[name](spark, folder).count()
                print(f"rows {name}: {n} rows, {time.time() - began:.1f} s", flush=True)
            except Exception as e:
                print("ERROR", name, str(e)[:600], flush=True)
            continue
        try:
            good, text = compare(spark, con, folder, name, queries[name], sql[name])
            print("ok " if good else "BAD", text[:1500], flush=True)
        except Exception as e:
            print("ERROR", name, str(e)[:600], flush=True)
