"""Compare every registered query with its check SQL, row by row.

Usage: python tests/check.py [folder] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def rows_of(names, raw):
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in raw]
    return [names[i] for i in order], sorted(rows, key=_key)


def compare(df, con, sql) -> str:
    """Empty when equal, else the first difference."""
    mine_names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    other_names, other = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if mine_names != other_names:
        return f"columns {mine_names} against {other_names}"
    if len(mine) != len(other):
        return f"{len(mine)} rows against {len(other)}"
    for a, b in zip(mine, other):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} against {b}"
    return ""


def main() -> int:
    import __spark_entry__ as entry
    from fiscus.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            if name in oracle:
                problem = compare(df, con, oracle[name])
            else:
                problem = "" if df.count() else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        kind = "sql " if name in oracle else "rows"
        print(f"{'BAD' if problem else 'ok ':4}{kind} {time.time() - start:6.1f}s {name} {problem}",
              flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
