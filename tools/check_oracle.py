"""Runs registered queries against their oracle SQL on one folder of tables.

usage: python tools/check_oracle.py [--dir DIR] [--slow SECONDS] [prefix ...]
"""

from __future__ import annotations

import argparse
import importlib
import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False, name=None):
        out = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                out.append("null")  # noqa
            elif isinstance(v, bool):
                out.append(str(v))
            elif hasattr(v, "item"):
                out.append(f"{float(v):.6f}" if not isinstance(v.item(), (bool, str)) else str(v))
            elif isinstance(v, (int, float)):
                out.append(f"{float(v):.6f}")
            else:
                out.append(str(v))
        rows.append(tuple(out))
    return sorted(rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("prefixes", nargs="*")
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("--slow", type=float, default=4.0)
    args = parser.parse_args()
    from panelwright.session import local_session

    entry = importlib.import_module("__spark_entry__")
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{args.dir}/{t}.parquet')")
    oracle = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if args.prefixes and not any(name.startswith(p) for p in args.prefixes):
            continue
        start = time.time()
        try:
            got = fn(spark, args.dir).toPandas()
        except Exception as error:  # report and go on to the next query
            bad += 1
            print(f"ERROR {name}: {str(error)[:900]}", flush=True)
            if "--trace" in sys.argv:
                traceback.print_exc()
            continue
        took = time.time() - start
        note = f" SLOW {took:.1f}s" if took > args.slow else ""
        if name not in oracle:
            print(f"rows  {name}: {len(got)} rows{note}", flush=True)
            if len(got) == 0:
                print(f"EMPTY {name}")
            continue
        try:
            result = con.execute(oracle[name])
            kinds = {d[0]: str(d[1]) for d in result.description}
            want = result.df()
        except Exception as error:  # report and go on to the next query
            bad += 1
            print(f"ORACLE ERROR {name}: {str(error)[:900]}", flush=True)
            continue
        problems = []
        odd = {k: v for k, v in kinds.items() if v in ("HUGEINT", "DATE", "TIMESTAMP") or v.startswith("DECIMAL")}
        if odd:
            problems.append(f"types {odd}")
        if sorted(got.columns) != sorted(want.columns):
            problems.append(f"columns {sorted(set(got.columns) ^ set(want.columns))}")
        elif len(got) != len(want):
            problems.append(f"rows {len(got)} vs {len(want)}")
        else:
            a, b = canonical(got), canonical(want)
            if a != b:
                diff = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
                problems.append(f"{len(diff)} differing rows, cols {sorted(got.columns)}\n   {diff[0][0]}\n   {diff[0][1]}")
        if len(got) == 0:
            problems.append("empty")
        else:
            nulls = [c for c in got.columns if got[c].isna().all()]
            if nulls:
                note += f" all-null {nulls}"
        if problems:
            bad += 1
            print(f"FAIL  {name}: {'; '.join(problems)}{note}", flush=True)
        else:
            print(f"ok    {name}: {len(got)} rows{note}", flush=True)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
