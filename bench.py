"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, optional).  Each query is fully executed with the
``noop`` sink (no driver collect); prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "d04_label_base_rates",      # panel -> labels -> rollup
    "e11_featured_dataset",      # 20 features, one window family
    "e13_serving_features",      # serving profile, all days
    "e22_week_over_week",        # read model
    "d16_point_biserial",        # one-pass correlations
    "j18_evaluation",            # metrics + distributed AUC/AP + lead time
    "k03_exact_allocation",      # exact plans for 10 what-if families
    "k12_budget_sweep",          # 19 budgets x entities
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    from veldt.plans import catalog, registry
    from veldt.session import get_spark

    catalog.load_all()
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, cpus * 2))
    times = {}
    for n in names:
        t0 = time.time()
        registry.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
