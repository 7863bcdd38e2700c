"""Compare registered queries with their SQL on DuckDB. Usage: oracle_check.py [sf] [name...]"""

from __future__ import annotations

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels
conversations""".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(columns)[i] for i in order]), sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t0
    if sql is None:
        return "rows-only", took, len(left[1]), None
    cur = con.execute(sql)
    right = rows_of([c[0] for c in cur.description], cur.fetchall())
    if left == right:
        return "ok", took, len(left[1]), None
    diff = {"columns": (left[0], right[0])} if left[0] != right[0] else {
        "n": (len(left[1]), len(right[1])),
        "spark_only": [r for r in left[1] if r not in set(right[1])][:3],
        "sql_only": [r for r in right[1] if r not in set(left[1])][:3],
    }
    return "DIFF", took, len(left[1]), diff


def main(argv):
    import __spark_entry__ as entry
    from mentionlake.session import get_session

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = get_session("oracle-check", "local[8]", 8)
    spark.sparkContext.setLogLevel("OFF")
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = []
    for name, fn in entry.queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        try:
            status, took, n, diff = compare(spark, con, fn, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            status, took, n, diff = "ERROR", 0.0, 0, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{status:9s} {name:28s} rows={n:<7d} {took:6.2f}s", flush=True)
        if diff:
            print("   ", str(diff)[:1500], flush=True)
        if status in ("DIFF", "ERROR"):
            bad.append(name)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
