"""Runs registered queries against their DuckDB statements: ``python tests/oracle_check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import pathlib
import sys
import time

import duckdb

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None:
        return ("null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return ("n", "nan" if math.isnan(f) else f"{f:.9g}")
    if isinstance(v, dt.datetime):
        return ("d", v.isoformat())
    if isinstance(v, dt.date):
        return ("d", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", *[_cell(x) for x in v])
    return ("s", str(v))


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when both agree, else a short account of the difference."""
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    rows = sorted(tuple(_cell(r[c]) for c in names) for r in got.collect())
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    if sorted(cols) != names:
        return f"columns {names} vs {sorted(cols)}"
    at = {c: i for i, c in enumerate(cols)}
    want = sorted(tuple(_cell(r[at[c]]) for c in names) for r in cur.fetchall())
    if rows == want:
        return None
    have, need = set(rows), set(want)
    missing = [r for r in want if r not in have][:3]
    extra = [r for r in rows if r not in need][:3]
    return f"{len(rows)} vs {len(want)} rows\n  names {names}\n  only oracle {missing}\n  only spark {extra}"


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries

    from tallyspark.spark_tools import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, failed = connect(sf_dir), oracle_sql(), []
    for name, query in queries().items():
        if argv[1:] and name not in argv[1:]:
            continue
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, query, oracles[name], sf_dir)
            else:
                problem = None if query(spark, sf_dir).count() else "no rows"
        except Exception as e:  # noqa: BLE001 - the report goes on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        mark = ("ok" if name in oracles else "rows") if problem is None else "FAIL"
        print(f"{mark:5} {name:32} {time.time() - start:6.2f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
