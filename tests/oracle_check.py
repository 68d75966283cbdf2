"""Run registered queries and their SQL checks side by side.

python tests/oracle_check.py [--sf DIR] [--only PREFIX[,PREFIX]]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time
import traceback
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        v = round(v, 6)
        return 0.0 if v == 0 else v
    if isinstance(v, int):
        return float(v)
    return str(v)


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=key)


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def compare(spark, con, fn, sql, sf):
    df = fn(spark, sf)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got[1]), ""
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, len(got[1]), f"columns {got[0]} vs {want[0]}"
    if got[1] == want[1]:
        return True, len(got[1]), ""
    a, b = set(got[1]), set(want[1])
    return False, len(got[1]), f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b, key=key)[:3]}; only sql {sorted(b - a, key=key)[:3]}"


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--only", default="")
    args = ap.parse_args()
    from telemill.plans import catalog
    from telemill.session import builder

    spark = (
        builder("check").master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(args.sf)
    bad = 0
    only = [p for p in args.only.split(",") if p]
    for name, fn in sorted(catalog.QUERIES.items()):
        if only and not any(name.startswith(p) for p in only):
            continue
        t = time.time()
        try:
            ok, n, why = compare(spark, con, fn, catalog.ORACLES.get(name), args.sf)
        except Exception as e:  # report and go on
            ok, n, why = False, -1, "".join(traceback.format_exception_only(e))[:700]
        tag = {True: "ok  ", None: "rows", False: "FAIL"}[ok]
        bad += ok is False
        print(f"{tag} {name} rows={n} {time.time() - t:.1f}s {why}" + (" EMPTY" if n == 0 else ""), flush=True)
    print("failures:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
