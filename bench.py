"""Time the headline queries (median of three after a warm-up) and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from incidex.plans import load_all
from incidex.session import local_session

HEADLINE = [
    "voc1_build_vocab", "voc11_coverage", "voc12_sweep", "voc3_build_lookup", "rul1_cooccurrence", "rul5_itemsets",
    "rul9_dnf_rules", "rul20_correlates", "met1_auc_by_item", "met7_grouped_correlations",
    "agg1_build_tidy", "agg22_ranking_stability",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    registry = load_all()
    times = {}
    run = lambda name: registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # start-up and first compilation are not a query's cost
    for name in HEADLINE:
        seconds = []
        for _ in range(3):
            start = time.time()
            run(name)
            seconds.append(time.time() - start)
        times[name] = round(statistics.median(seconds), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
