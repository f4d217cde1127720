"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Every query runs over whole tables into a no-op sink. One warm-up query pays for JVM start.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import tables  # noqa: E402
from checks.registry import all_checks  # noqa: E402
from ledgerwatch import build_session  # noqa: E402
from ledgerwatch.plans.detection import take_in  # noqa: E402
from ledgerwatch.session import ensure_checkpoint_dir  # noqa: E402
from ledgerwatch.streaming.detect import Sinks, detect_stream  # noqa: E402

HEADLINE = (
    "detect_flagship",
    "degraded_detect",
    "trailing_window_5m",
    "arrival_window_day",
    "first_wins",
    "append_once",
    "paysim_events",
    "paysim_rejects",
    "replay_validate",
    "replay_counts",
    "dataset_violations",
    "evaluate",
    "threshold_regression",
    "balance_rules",
    "reprocess",
    "reconcile",
    "latency_percentiles",
    "alert_windows",
    "leak_scan_text",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    checks = all_checks()
    checks["risk_level_counts"].run(spark, sf_dir).collect()

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        checks[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)

    folder = f"{ensure_checkpoint_dir(spark)}/bench-{uuid.uuid4().hex}"
    schema = tables.read(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/event*.parquet")
    start = time.perf_counter()
    sinks = Sinks.under(folder)
    detect_stream(
        take_in(tables.tx_of(stream)).accepted, sinks, available_now=True
    ).awaitTermination()
    seconds["stream_detect"] = round(time.perf_counter() - start, 3)
    scored = spark.read.parquet(sinks.results).count()

    events = tables.read(spark, sf_dir, "events").count()
    orders = tables.read(spark, sf_dir, "orders").count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "rows_per_second": {
                    "detect_flagship": round(events / seconds["detect_flagship"]),
                    "paysim_events": round(orders / seconds["paysim_events"]),
                    "evaluate": round(orders / seconds["evaluate"]),
                    "stream_detect": round(scored / seconds["stream_detect"]),
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
