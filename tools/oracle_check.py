"""Run registered Spark queries and their DuckDB oracle side by side.

Usage: python tools/oracle_check.py [--sf /root/testdata/sf0.01] [key ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillspark.plans.compare import compare, duck_connect  # noqa: E402
from quillspark.plans.registry import all_oracles, all_queries  # noqa: E402
from quillspark.session import build_session  # noqa: E402


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    spark = build_session("local[8]", 8)
    con = duck_connect(a.sf)
    qs, os_ = all_queries(), all_oracles()
    bad = []
    for k in a.keys or sorted(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, a.sf)
            if k not in os_:
                n = df.count()
                print(f"{k:10s} rows-only {n} rows {time.time() - t0:.1f}s")
                continue
            msgs = compare(df, con, os_[k])
        except Exception as e:  # noqa: BLE001
            msgs = [f"ERROR {type(e).__name__}: {str(e)[:300]}"]
        print(f"{k:10s} {'OK' if not msgs else 'MISMATCH ' + '; '.join(msgs)} ({time.time() - t0:.1f}s)")
        if msgs:
            bad.append(k)
    print("BAD:", bad)


if __name__ == "__main__":
    main()
