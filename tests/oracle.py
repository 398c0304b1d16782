"""Compare a registered query with its SQL in DuckDB.

Run directly to check queries by name:  python tests/oracle.py [sf] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

DATA = "/root/testdata"


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    return v


def run_sql(sf: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = [str(d[1]) for d in rel.description]
    return names, types, rel.fetchall()


def compare(spark, sf: str, fn, sql: str | None) -> str | None:
    """None when equal, else a description of the difference."""
    frame = fn(spark, f"{DATA}/{sf}")
    rows = frame.collect()
    if sql is None:
        return None if rows else "no rows"
    names, types, expected = run_sql(sf, sql)
    mine = sorted(frame.columns)
    if mine != sorted(names):
        return f"columns {mine} vs {sorted(names)}"
    simple = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "float": "FLOAT",
    }
    kinds = dict(zip(names, types))
    for f in frame.schema:
        want = simple.get(f.dataType.simpleString())
        if want and want != kinds[f.name].upper():
            return f"type of {f.name}: {f.dataType.simpleString()} vs {kinds[f.name]}"
    at = [names.index(c) for c in mine]
    left = Counter(tuple(_cell(r[c]) for c in mine) for r in rows)
    right = Counter(tuple(_cell(r[i]) for i in at) for r in expected)
    if left == right:
        return None if rows else "both empty"
    only_l, only_r = list((left - right).items())[:3], list((right - left).items())[:3]
    return (
        f"rows {len(rows)} vs {len(expected)}; {sum((left - right).values())} differ\n"
        f"   cols {mine}\n   spark {only_l}\n   sql   {only_r}"
    )


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from millrace.queries import load_all

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    wanted = sys.argv[2:]
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, (fn, sql) in sorted(load_all().items()):
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            diff = compare(session, sf, fn, sql)
        except Exception as exc:  # noqa: BLE001 - report and go on
            text = str(exc)
            diff = f"{type(exc).__name__}: {text[:700]}"
        bad += diff is not None
        status = "ok  " if diff is None else "FAIL"
        print(f"{status} {name:34s} {time.time() - t:6.2f}s {'' if sql else '(rows only)'}", flush=True)
        if diff:
            print("   ", diff, flush=True)
    sys.exit(1 if bad else 0)
