"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a13_standings", "w01_canonical", "w07_form", "w08_streak", "w09_head_to_head", "w11_running_standings", "j07_asof_rating", "k01_upsert", "u03_source_merge",
    "f33_score_distribution", "m04_count_model", "d11_reason_tags", "t04_tickets", "a22_calibration", "g07_pagerank", "g01_rating_replay", "a19_event_stats", "j12_substring_near_date",
]


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from touchline import catalog
    from touchline.queries import quality

    found, took = catalog.queries(), {}
    found["a01_coverage"](spark, sf_dir).collect()  # starts the executors

    def seconds(work) -> float:
        began = time.perf_counter()
        work()
        return round(time.perf_counter() - began, 3)

    def run(name: str) -> None:
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    # the canonical rows that most queries read are written once, and that is a time of its own
    took["canonical_write"] = seconds(lambda: quality.canon(spark, sf_dir))
    for name in HEADLINE:
        took[name] = seconds(lambda name=name: run(name))
    out = {"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    if os.environ.get("BENCH_FRESH"):  # each query with the shared rows still to be written
        fresh = {}
        for name in HEADLINE:
            quality.forget_canon()
            fresh[name] = seconds(lambda name=name: run(name))
        out["fresh"] = fresh
    print(json.dumps(out))


if __name__ == "__main__":
    main()
