"""Run queries on Spark and their SQL on DuckDB, and report what differs.

    python -m checks.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: [(x is None, str(type(x)), x) for x in r])


def main() -> int:
    import duckdb
    from pyspark.sql import SparkSession

    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    sf = f"/root/testdata/sf{args.sf}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    failed = 0
    for name in args.names or list(QUERIES):
        start = time.perf_counter()
        try:
            df = QUERIES[name](spark, sf)
            cols, got = canonical(df.columns, [tuple(r) for r in df.collect()])
        except Exception as exc:  # noqa: BLE001  report and go on
            print(f"FAIL {name}: {str(exc)[:600]}", flush=True)
            failed += 1
            continue
        took = time.perf_counter() - start
        if name not in ORACLE:
            print(f"rows {name}: {len(got)} rows in {took:.2f}s  {df.columns} {got[:1]}", flush=True)
            continue
        try:
            rel = db.execute(ORACLE[name])
            desc = [d[0] for d in rel.description]
            types = {d[0]: str(d[1]) for d in rel.description}
            cols2, want = canonical(desc, rel.fetchall())
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: oracle {str(exc)[:600]}", flush=True)
            failed += 1
            continue
        problem = ""
        if cols != cols2:
            problem = f"columns {cols} vs {cols2}"
        elif len(got) != len(want):
            problem = f"{len(got)} rows vs {len(want)}"
        else:
            diff = [(a, b) for a, b in zip(got, want) if a != b]
            if diff:
                problem = f"{len(diff)} rows differ, first {diff[0]}"
        kinds = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE"}
        off = {c: (d, types[c]) for c, d in df.dtypes if c in types and kinds.get(d, d) != types[c].upper()}
        note = f"  types {off}" if off else ""
        print(f"{'FAIL' if problem else 'ok  '} {name}: {len(got)} rows in {took:.2f}s {problem}{note}", flush=True)
        failed += bool(problem)
    print(f"{failed} failed", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
