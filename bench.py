"""Times the headline queries: python bench.py

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_REPEATS (default 1, median reported after one
warm-up run). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyscope.plans.all import QUERIES  # noqa: E402
from tallyscope.session import local_session  # noqa: E402
from tallyscope.sources.model import Model  # noqa: E402

HEADLINE = [
    "slide_class_summary",
    "slide_class_summary_stored",
    "classify_candidates",
    "judge",
    "threshold_preview",
    "review_overlay",
    "catalog_rows",
    "datasets",
    "datasets_by_locality",
    "rebind_reviews",
    "match_predictions",
    "pr_sweep",
    "neighbor_box_links",
    "group_series",
    "separability",
    "core_profiles",
    "derived_depth_series",
    "normalize_current",
    "save_review",
    "export_reviews",
    "export_labels",
    "vocab_mentions",
    "taxon_master",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2))
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for i in range(repeats + 1):
            start = time.perf_counter()
            # Every row and column is computed; nothing is brought to the driver.
            QUERIES[name](Model(spark, folder)).write.format("noop").mode("overwrite").save()
            if i or repeats == 0:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
