"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS the
cores, BENCH_QUERIES a comma-separated choice (``all`` for every query).
"""

from __future__ import annotations

import json
import os
import time

import pyspark

from threatloom.plans.queries import registry
from threatloom.session import local_session

HEADLINE = [
    "spam_layer",
    "nlp_layer",
    "media_layer",
    "threat_report",
    "alert_payload_json",
    "url_reputation",
    "header_multimap",
    "body_assemble",
    "attachment_budget",
    "archive_early_stop",
    "text_hash_dedup",
    "fetch_cycle",
    "latency_percentiles",
    "metrics_summary",
    "log_parse",
    "sanitize_log",
    "eml_ingest",
    "stream_monitor",
]


def timed(run, spark, folder: str, repeats: int) -> float:
    """Best of several runs, results computed in full and thrown away."""
    best = float("inf")
    for _ in range(repeats):
        start = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return best


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    known = registry()
    names = list(known) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus, **{"threatloom.samplePartitions": str(cpus)})
    seconds = {}
    for name in names:
        seconds[name] = round(timed(known[name], spark, folder, repeats), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "spark": pyspark.__version__,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
