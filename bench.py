"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local threads), BENCH_QUERIES
(comma-separated names, optional).  Every query writes its whole result to a sink
that discards it; the time covers building the plan and running it.  Each query
runs twice: the second run is reported, the first ones (with class loading and
code generation) are added up as ``first_run_total``.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablepact import catalogue  # noqa: E402
from tablepact.session import configured  # noqa: E402

HEADLINE = (
    "clean_and_check_lineitem", "clean_lineitem", "clean_orders", "clean_users", "clean_transactions",
    "clean_json_props", "clean_document_lengths", "deduplicate_lineitem", "checks_orders", "checks_transactions",
    "clean_check_and_write_orders", "row_errors_orders", "root_causes_users", "frame_issues_users",
    "infer_schema_orders", "infer_schema_users", "compare_orders", "quality_report_lineitem",
    "quality_report_documents", "staging_counters_orders", "bad_value_histogram", "duplicate_keys_lineitem",
    "duplicate_texts", "differing_runs", "strict_load_orders", "stage_csv_orders", "recent_errors",
    "log_level_windows", "attempt_counters", "repeated_errors", "adhoc_sql",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (configured(SparkSession.builder.master(f"local[{cpus}]").appName("tablepact-bench"))
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = session()
    queries = catalogue.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds, first_total = {}, 0.0
    for name in names:
        for attempt in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if attempt == 0:
                first_total += took
        seconds[name] = round(took, 3)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    result = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "first_run_total": round(first_total, 3),
    }
    if "clean_and_check_lineitem" in seconds:
        result["clean_and_check_rows_per_sec"] = round(rows / seconds["clean_and_check_lineitem"])
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
