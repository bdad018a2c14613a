"""Command line sweep over the registered queries: python tests/sweep.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness import engine, problems  # noqa: E402

from tallyscope.plans.all import ORACLES, QUERIES  # noqa: E402
from tallyscope.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(), engine(folder)
    names = [n for n in QUERIES if len(sys.argv) < 3 or any(n.startswith(p) for p in sys.argv[2:])]
    bad = 0
    for n in names:
        t = time.time()
        try:
            why, count = problems(spark, con, folder, QUERIES[n], ORACLES.get(n))
        except Exception as e:  # noqa: BLE001
            why, count = f"{type(e).__name__}: {str(e).split(chr(10))[0][:500]}", -1
        bad += bool(why)
        print(f"{'FAIL' if why else 'ok  '} {n} rows={count} {time.time() - t:.1f}s {'' if n in ORACLES else '(no sql)'} {why}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
