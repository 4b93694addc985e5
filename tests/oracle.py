"""Compare registered queries with their check SQL: python tests/oracle.py [sf] [name-prefix ...]"""

from __future__ import annotations

import glob
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False):
        out = []
        for v in row:
            if v is None or (not isinstance(v, (list, tuple, dict)) and pd.isna(v)):
                out.append("~")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                out.append(str(bool(v)))
            elif isinstance(v, (int, float)) or hasattr(v, "dtype") or type(v).__name__ == "Decimal":
                out.append(f"{float(v) + 0.0:.8f}")
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    start = time.time()
    got_df = fn(spark, sf_dir)
    got = got_df.toPandas()
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(got)} rows {took:.1f}s"
    start = time.time()
    want = con.execute(sql).df()
    duck_took = time.time() - start
    if sorted(got.columns) != sorted(want.columns):
        return f"FAIL columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = normal(got), normal(want)
    if a != b:
        sa, sb = set(a), set(b)
        return (f"FAIL rows {len(a)} vs {len(b)}; only spark {len(sa - sb)} only sql {len(sb - sa)}\n  cols {sorted(got.columns)}\n"
                f"  spark {sorted(sa - sb)[:2]}\n  sql   {sorted(sb - sa)[:2]}")
    return f"ok {len(a)} rows {took:.1f}s (sql {duck_took:.1f}s)"


def main() -> int:
    from evalgate.plans.catalog import ORACLES, QUERIES
    from evalgate.session import local_session

    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            result = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as exc:
            result = "FAIL " + "".join(traceback.format_exception_only(exc))[:700]
        bad += result.startswith("FAIL")
        print(f"{name}: {result}", flush=True)
    print(f"{bad} failures")
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
