"""Compare queries against DuckDB: python tests/run_check.py [sf] [name or prefix* ...]"""

from __future__ import annotations

import fnmatch
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
from compare import compare, duck  # noqa: E402

from trackloom.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    patterns = sys.argv[2:] or ["*"]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if not any(fnmatch.fnmatch(name, p) for p in patterns):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if df.count() > 0 else "no rows"
            status = "ok" if problem is None else f"DIFF {problem}"
            if name not in oracles:
                status += " (rows only)"
        except Exception as error:  # noqa: BLE001
            status = f"ERROR {type(error).__name__} {str(error)[:300]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not status.startswith("ok")
        print(f"{name:34s} {time.time() - start:6.2f}s {status}", flush=True)
    print("failures:", bad)
