"""Run registered queries against their SQL in DuckDB: python tests/oracle.py FOLDER [name …]"""

import datetime
import math
import os
import sys
import time
from decimal import Decimal

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0 if value else 0.0)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return "NULL" if value is None else str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, queries, oracles):
    begun = time.time()
    df = queries[name](spark, folder)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - begun
    if name not in oracles:
        return None, f"{len(got[1])} rows, no SQL", spent
    cur = con.execute(oracles[name])
    want = normal([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", spent
    if got[1] != want[1]:
        extra = [r for r in got[1] if r not in set(want[1])][:3]
        short = [r for r in want[1] if r not in set(got[1])][:3]
        return False, f"{got[0]}\n  {len(got[1])} rows != {len(want[1])}\n  spark only {extra}\n  sql only {short}", spent
    return True, f"{len(got[1])} rows", spent


if __name__ == "__main__":
    from tieout.queries import ORACLES, QUERIES
    from tieout.session import build_session

    folder = sys.argv[1]
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(folder), 0
    for name in sys.argv[2:] or QUERIES:
        try:
            ok, note, spent = compare(spark, con, folder, name, QUERIES, ORACLES)
        except Exception as problem:  # noqa: BLE001
            ok, note, spent = False, f"{type(problem).__name__}: {str(problem)[:600]}", 0
        bad += ok is False
        print({True: "ok  ", False: "FAIL", None: "rows"}[ok], f"{name:32s} {spent:6.2f}s {note}", flush=True)
    print("failed:", bad)
