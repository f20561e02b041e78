"""Benchmark: the warehouse workflow on Spark.

1. ``load_star``: conform the driver tables in ``$BENCH_SF_DIR`` to the star
   and write it as parquet (under the session's ``spark.checkpoint.dir``);
2. ``q1`` .. ``q8``: the eight warehouse queries over the stored star
   (median of 3 runs after one warm-up run each);
3. ``e2e_q1`` .. ``e2e_q8``: the same queries straight from the driver
   tables (conform + query in one plan), one run each;
4. ``q23_load_report``, ``q24_quality_report`` over the stored star;
5. ``rollup_load``: two loads of half of the fact's lines each into stored roll-ups, and
   ``rollup_q1`` .. ``rollup_q8``: the queries that roll-ups serve (one run after a warm-up).

Prints one JSON line; ``value`` = load_star + q1..q8.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

from tillstar.plans import analytics as A  # noqa: E402
from tillstar.plans import quality as Q  # noqa: E402
from tillstar.plans.conform import star_from_dir  # noqa: E402
from tillstar.plans.rollups import RollupStore  # noqa: E402
from tillstar.session import local_session, scratch_path  # noqa: E402
from tillstar.sources.parquet_store import read_star, write_star  # noqa: E402

QUERIES = {
    "q1": ("kpi_overview", A.kpi_overview),
    "q2": ("category_performance", A.category_performance),
    "q3": ("channel_performance", A.channel_performance),
    "q4": ("region_performance", A.region_performance),
    "q5": ("customers_by_loyalty_tier", A.customers_by_loyalty_tier),
    "q6": ("top_selling_products", lambda s: A.top_selling_products(s, 10)),
    "q7": ("monthly_revenue_trends", A.monthly_revenue_trends),
    "q8": ("top_customers", lambda s: A.top_customers(s, 10)),
}


ROLLUP_QUERIES = {
    "q1": lambda r, s: r.kpi_overview(),
    "q2": lambda r, s: r.category_performance(s),
    "q3": lambda r, s: r.channel_performance(),
    "q4": lambda r, s: r.region_performance(s),
    "q6": lambda r, s: r.top_selling_products(s, 10),
    "q7": lambda r, s: r.monthly_revenue_trends(),
    "q8": lambda r, s: r.top_customers(s, 10),
}


def _timed(fn) -> float:
    t = time.perf_counter()
    fn()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None

    spark = local_session(cores=cpus, shuffle_partitions=cpus, app="tillstar-bench",
                          extra={"spark.driver.memory": "16g",
                                 # file / partition target sized for this data, as a cluster would
                                 "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"})
    out: dict[str, float] = {}

    # warm the JVM on the smallest data set
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        A.top_selling_products(star_from_dir(spark, small), 10).collect()

    root = scratch_path(spark, "bench-star")
    out["load_star"] = _timed(lambda: write_star(star_from_dir(spark, sf_dir), root))
    star = read_star(spark, root)

    for key, (_, fn) in QUERIES.items():
        fn(star).collect()  # warm-up (plans, file listing)
        runs = [_timed(lambda: fn(star).collect()) for _ in range(3)]
        out[key] = statistics.median(runs)

    for key, (_, fn) in QUERIES.items():
        out[f"e2e_{key}"] = _timed(lambda: fn(star_from_dir(spark, sf_dir)).collect())

    # the load and quality reports over the stored star (informational)
    out["q23_load_report"] = _timed(lambda: Q.load_report(star).collect())
    out["q24_quality_report"] = _timed(lambda: Q.quality_report(star).collect())

    # the same queries from roll-ups of two loads of the fact (informational)
    rollups = RollupStore(spark, scratch_path(spark, "bench-rollups"))
    out["rollup_load"] = _timed(lambda: [rollups.add(str(k), star.fact.where(f"sale_sk % 2 = {k}"), star.time) for k in range(2)])
    for key, fn in ROLLUP_QUERIES.items():
        fn(rollups, star).collect()
        out[f"rollup_{key}"] = _timed(lambda: fn(rollups, star).collect())

    value = out["load_star"] + sum(out[k] for k in QUERIES)
    print(json.dumps({
        "metric": "star_load_plus_q1_q8",
        "value": round(value, 3),
        "unit": "sec",
        "queries": {k: round(v, 3) for k, v in out.items()},
        "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
