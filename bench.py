"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3; the median is kept after one warm-up run).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = {
    "baseline_graph": ["e6_baseline_graph"],
    "historical_demand": ["e11_historical_demand"],
    "latent_demand": ["e15_latent_demand"],
    "destination_distribution": ["j8_destination_distribution"],
    "market_chain": [],
    "exp3_weights": ["l2_exp3_weights"],
    "q_replay": ["l7_q_replay"],
    "phase_summary": ["e19_phase_summary"],
    "assigned_destinations": ["k13_assigned_destinations"],
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("curbside-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    from curbside.catalog import QUERIES
    from curbside.catalog.inputs import Inputs
    from curbside.plans.market_plan import evaluate_policies
    from curbside.sources.staging import stage

    def finish(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    # the market chain starts from tables that the other headline queries make
    t = Inputs(spark, sf_dir)
    tables = (t.policy, t.inventory, stage(t.latent, "latent"), t.dest_prob, stage(t.graph, "graph"))

    def market_chain() -> None:
        step = evaluate_policies(*tables)
        finish(step.revenue)
        finish(step.inventory)

    def once(names: list[str]) -> float:
        start = time.perf_counter()
        for name in names:
            finish(QUERIES[name](spark, sf_dir))
        if not names:
            market_chain()
        return time.perf_counter() - start

    times = {}
    for label, names in HEADLINE.items():
        once(names)
        times[label] = round(statistics.median(once(names) for _ in range(runs)), 3)
    trips = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "trips": trips,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
