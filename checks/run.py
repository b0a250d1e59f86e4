"""Run registered queries and compare them with their SQL in DuckDB.

    python -m checks.run [--sf 0.01] [names...]
"""

import argparse
import datetime
import decimal
import glob
import math
import os
import time

import duckdb

import checks
from citeline.session import local_session, scratch

DATA = "/root/testdata"


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (int(value) if value.is_integer() else value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, name, folder):
    started = time.time()
    with scratch(spark):
        df = checks.QUERIES[name](spark, folder)
        mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if name not in checks.SQL:
        return f"rows only   {len(mine):>7} rows {took:6.1f}s"
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        view = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {view} AS SELECT * FROM '{path}'")
    started = time.time()
    result = db.execute(checks.SQL[name])
    names = [d[0] for d in result.description]
    theirs = rows_of(names, result.fetchall())
    asked = time.time() - started
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(names)}"
    if mine == theirs:
        return f"ok          {len(mine):>7} rows {took:6.1f}s  (sql {asked:.1f}s)"
    a, b = set(map(repr, mine)), set(map(repr, theirs))
    text = f"DIFFERS {len(mine)} / {len(theirs)} rows; only here {len(a - b)}, only there {len(b - a)}"
    for label, some in (("here", a - b), ("there", b - a)):
        for row in sorted(some)[:3]:
            text += f"\n    {label}: {row[:600]}"
    return text


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    checks.load()
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    for name in args.names or checks.QUERIES:
        try:
            print(f"{name:<24} {compare(spark, name, f'{DATA}/sf{args.sf}')}", flush=True)
        except Exception as error:  # noqa: BLE001 - report and go on
            print(f"{name:<24} ERROR {type(error).__name__}: {str(error)[:1500]}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
