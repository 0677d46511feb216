"""Run registered queries against their SQL in DuckDB: python tests/check_oracle.py [sf] [name prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def canon(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(canon(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, canon(v)) for k, v in value.items()))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def compare(spark, con, sf_dir, name, build, sql):
    t0 = time.time()
    frame = build(spark, sf_dir)
    got = frame.collect()
    took = time.time() - t0
    cols, mine = rows_of(frame.columns, [tuple(r) for r in got])
    if sql is None:
        return "rows", len(mine), f"spark {took:.1f}s"
    cur = con.execute(sql)
    ocols, theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return "FAIL", len(mine), f"columns {cols} != {ocols}"
    if mine != theirs:
        only = [r for r in mine if r not in set(theirs)][:3]
        other = [r for r in theirs if r not in set(mine)][:3]
        return "FAIL", len(mine), f"rows {len(mine)} vs {len(theirs)}\n   mine   {str(only)[:1500]}\n   oracle {str(other)[:1500]}"
    return ("ok" if mine else "EMPTY"), len(mine), f"spark {took:.1f}s"


def main() -> int:
    import __spark_entry__ as entry
    from sourceline.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(sf_dir)
    oracles, bad = entry.oracle_sql(), 0
    for name, build in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            status, n, note = compare(spark, con, sf_dir, name, build, oracles.get(name))
        except Exception as error:
            status, n, note = "ERROR", 0, str(error)[:1500]
        bad += status in ("FAIL", "ERROR", "EMPTY")
        print(f"{status:6} {name:40} {n:7} rows {time.time() - t0:6.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
