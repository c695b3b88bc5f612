"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local threads.  Each query
runs once to warm up and once timed, writing all rows to the no-op sink.
"""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from cuelake.plans.queries import QUERIES  # noqa: E402

HEADLINE = ["quality_stats", "normalize_track", "duplicate_merge", "cue_build", "ocr_interval_gate", "pts_repair",
            "ctc_collapse", "reading_order", "length_bucket_pack", "decision_parity", "context_window", "prompt_rows",
            "strong_prefilter", "document_samples", "target_validate", "json_repair", "export_srt", "srt_parse_strict",
            "summary_parse", "asset_verify"]


def main(names):
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main(list(QUERIES) if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE)
