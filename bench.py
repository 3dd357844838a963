"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line. Every run builds its frames anew."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

from quillon import queries
from quillon.operators import profile
from quillon.sources import warehouse

HEADLINE = [
    "profile_customer", "profile_orders", "profile_lineitem", "profile_events", "profile_documents", "null_rates", "sample_dominant_shape",
    "residual_customer", "residual_orders_day", "residual_events", "mart_daily", "grain_daily", "residual_weighted_daily", "uniqueness_sweep",
    "null_effect", "postal_floor", "evidence", "verdicts", "lineage_edges", "lineage_upstream_tables", "exposures", "masked_residual", "review_queue",
]
WIDTHS = [42, 168, 336]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, float] = {}

    def timed(name, make) -> None:
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        found[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()

    spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count().collect()  # starts the executors' threads
    for name in HEADLINE:
        timed(name, lambda name=name: queries.QUERIES[name](spark, sf_dir))
    for width in WIDTHS:
        timed(f"profile_wide_{width}", lambda width=width: profile.measured(warehouse.wide(spark, width, 5000)))
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
