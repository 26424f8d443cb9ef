"""Headline-query benchmark.

Runs the headline queries (J1 weighted features, A6 result summary, T4
packing, M12 subset fitness, J8 kNN) on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints one JSON line.
Each query is forced to completion with the ``noop`` sink (every row is
computed, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stoich.plans import catalog  # noqa: E402
from stoich.session import local_session, remove_tables  # noqa: E402

HEADLINE = ["j1_weighted_features", "a6_result_summary", "t4_pack_sequences",
            "m12_subset_fitness", "j8_knn_predict"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus) if cpus.isdigit() else 16))
    catalog.load_all()
    # warm the JVM and the Python workers on the smallest scale (not timed)
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        catalog.QUERIES["j1_weighted_features"](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        remove_tables(spark)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
