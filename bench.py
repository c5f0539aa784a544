"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from colloquy.plans import catalogue  # noqa: E402

HEADLINE = (
    "q02_sessionize", "q04_sliding_windows", "q05_turns", "q06_context_frames", "q07_response_pairs", "q11_top_phrases", "q15_awake_range", "q17_opening_stats", "q20_latency_stats",
    "q21_pii_redact", "q26_vector_topk", "q30_scored_retrieval", "q31_session_diversity", "q35_dedupe_keep_first", "q36_upsert", "q40_pack_blocks", "q44_next_profile_time",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        run = lambda: catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        run()  # compiles
        began = time.perf_counter()
        run()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
