"""Headline queries, timed end to end; prints one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from veilscan.session import builder, ship  # noqa: E402

TABLES = ("customer", "orders", "documents", "pages", "conversations", "events", "part", "supplier", "lineitem")
HEADLINE = (
    "category_counts",
    "scan_documents",
    "scan_pages",
    "scan_conversations",
    "detect_credit_card",
    "detect_email",
    "detect_phone",
    "detect_dob",
    "spans_dedupe",
    "context_snippet",
    "mask_documents",
    "mask_records",
    "mask_findings",
    "document_groups",
    "document_rank",
    "coverage_stats",
    "last_scan",
    "silent_hosts",
    "to_cef",
    "parse_cef",
    "assign_alerts",
    "scan_mail",
    "findings_stream",
)


def laid_out(spark, sf_dir: str, files: int) -> str:
    """A copy of the tables in several files each, as tables on a cluster are:
    a table in one row group is one task, whatever the cores. Not timed."""
    target = tempfile.mkdtemp(prefix="spark-")
    for name in TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        table.repartition(files).write.parquet(f"{target}/{name}.parquet")
    return target


def main() -> None:
    source = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("bench")
        .master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    sf_dir = laid_out(spark, source, int(cpus) if cpus.isdigit() else 8)
    # start the JVM's code paths with a scan
    QUERIES["scan_conversations"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(source.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
