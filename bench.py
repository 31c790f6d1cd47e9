"""Times the headline plans: one warm-up run each, then the median of three, every result written to Spark's no-op sink.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) say where and how. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from harborlight.plans.registry import PLANS
from harborlight.session import build_session

HEADLINE = (
    "worst_suppliers", "part_hub", "order_chain", "segment_stats", "conditional_counts", "pctile_suppliers", "pctile_orders", "latest_per_key", "price_flips",
    "quarter_grid", "exists_flags", "range_twins", "anomalies_weekly", "iqr_outliers", "token_counts", "vec_topk", "shared_owner_pairs", "bfs_hops", "radius_search", "upsert_merge",
    "linkage_pairs", "building_profile", "building_similar", "influence_flows", "entity_xref", "clustering",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for k in range(4):
            start = time.perf_counter()
            PLANS[name](spark, folder).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline plans, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
