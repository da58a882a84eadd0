"""Print the formatted physical plan of registered queries.

Usage: python tools/explain.py [--sf /root/testdata/sf0.01] key [key ...]
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quillspark.plans.registry import all_queries  # noqa: E402
from quillspark.session import build_session  # noqa: E402


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--mode", default="formatted")
    ap.add_argument("keys", nargs="+")
    a = ap.parse_args()
    spark = build_session("local[8]", 8)
    qs = all_queries()
    for k in a.keys:
        print(f"===== {k}")
        qs[k](spark, a.sf).explain(a.mode)


if __name__ == "__main__":
    main()
