"""Time all queries of the file, response and record operators and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local cores. Each
of the long known headline queries runs once to warm up and once for the clock, the
others run once; all rows are computed and thrown away.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from corpuscope.plans import QUERIES

HEADLINE = list(QUERIES)

# those timed from the first round on
WARMED = {
    "corpus_job", "text_stats", "extract_stage", "transform_stage", "file_type_counts", "directory_summary",
    "scrape_pages", "html_text", "html_links", "apply_rules", "rule_default", "apply_transform", "fetch_json",
    "api_result", "status_summary", "build_requests", "exists_flag", "resolve_calls", "last_wins", "result_counts",
    "probe_sections", "report_lines", "read_text_files", "write_json",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2 if name in WARMED else 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds[name] for name in WARMED), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
