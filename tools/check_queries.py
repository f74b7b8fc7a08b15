"""Run registered queries against their SQL counterparts: ``check_queries.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int,)):
        return value
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        if math.isnan(value):
            return "nan"
        return int(value) if value == int(value) else round(value, 6)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def check(spark, con, sf_dir, name, fn, sql):
    started = time.time()
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    spark_time = time.time() - started
    if sql is None:
        return len(mine) >= 0, f"rows={len(mine)} no sql  spark {spark_time:.1f}s", mine, None
    started = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    theirs = rows_of(columns, result.fetchall())
    same = sorted(df.columns) == sorted(columns) and mine == theirs
    return same, f"rows={len(mine)}/{len(theirs)} spark {spark_time:.1f}s duckdb {time.time() - started:.1f}s", mine, theirs


def main() -> int:
    from marginalia.catalog import all_oracles, all_queries
    from marginalia.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.001"
    spark = build_session(
        "check", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
                                "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = all_queries(), all_oracles()
    wrong = []
    for name in args or queries:
        try:
            same, note, mine, theirs = check(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as error:  # report and go on with the next query
            same, note, mine, theirs = False, f"{type(error).__name__}: {str(error)[:500]}", [], []
        print(("ok   " if same else "FAIL ") + name, note, flush=True)
        if not same:
            wrong.append(name)
            left = [r for r in mine if r not in set(theirs or [])][:3]
            right = [r for r in (theirs or []) if r not in set(mine)][:3]
            print("   only spark:", str(left)[:700], "\n   only sql:  ", str(right)[:700], flush=True)
    print(f"{len(wrong)} wrong: {wrong}")
    return 1 if wrong else 0


if __name__ == "__main__":
    raise SystemExit(main())
