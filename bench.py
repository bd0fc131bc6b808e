"""Benchmark the jobs at one scale factor; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The logical tables are first derived from the test tables and written once as a
Parquet warehouse (product history partitioned by date), as they would be stored in
production; the jobs then read that warehouse. Each job is run once to warm up and
``BENCH_RUNS`` times (default 3) to a ``noop`` sink (full execution, nothing collected
to the driver); the median is reported. ``value`` is the sum of the medians.
"""

from __future__ import annotations

import glob
import json
import os
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfwise.conf import ensure_checkpoint_dir, local_session  # noqa: E402
from shelfwise.params import TESTDATA_PROFILE as PR  # noqa: E402
from shelfwise.plans import (  # noqa: E402
    bundles, expected_sales, history, margin, purchase, replenishment, shipping, stock_health,
)
from shelfwise.sources import testdata  # noqa: E402
from shelfwise.sources.tables import from_warehouse, write_warehouse  # noqa: E402

HEADLINE = {
    "b1_contribution_margin": lambda t: margin.contribution_margin(t, PR.margin),
    "b2_replenishment_list": lambda t: replenishment.replenishment_list(t, PR.replenishment),
    "b3_stock_health": lambda t: stock_health.stock_health(t, PR.stock_health),
    "b4_stock_health_trend": lambda t: stock_health.stock_health_trend(t.stock_health_snapshots),
    "b5_expected_sales_leaf_blowers": lambda t: expected_sales.seasonal_expected_sales(t, PR.leaf_blower),
    "b6_expected_sales_lamps": lambda t: expected_sales.seasonal_expected_sales(t, PR.lamps),
    "b7_expected_sales_horizon": lambda t: expected_sales.horizon_expected_sales(t, PR.horizon),
    "b8_shipped_child_quantities": lambda t: bundles.shipped_child_quantities(t, PR.shipped_child),
    "b9_purchase_value": lambda t: purchase.purchase_value(t, PR.purchase_value),
    "b10_open_purchase_quantities": lambda t: purchase.open_purchase_quantities(t),
    "b11_current_stock": lambda t: purchase.current_stock(t),
    "b12_out_of_stock_base": lambda t: history.out_of_stock_base(t, PR.out_of_stock),
    "b13_shipping_lines": lambda t: shipping.shipping_lines(t, PR.shipping_time),
    "b14_stock_development": lambda t: history.stock_development(t),
}


def run_once(df) -> float:
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def _event_lines(path: str):
    """Lines of one (possibly zstd-compressed) rolling event-log file."""
    if path.endswith(".zstd"):
        import io

        import zstandard
        with open(path, "rb") as fh:
            reader = zstandard.ZstdDecompressor().stream_reader(fh)
            yield from io.TextIOWrapper(reader, encoding="utf-8")
    else:
        with open(path, encoding="utf-8") as fh:
            yield from fh


def shuffle_bytes_by_group(event_dir: str) -> dict[str, int]:
    """Shuffle bytes written per job group, summed over the task-end events of Spark's
    event log (each timed job runs under a job group named after its query)."""
    stage_group: dict[int, str] = {}
    written: dict[str, int] = {}
    for path in sorted(glob.glob(os.path.join(event_dir, "**", "events_*"), recursive=True)):
        for line in _event_lines(path):
            if line.strip():
                event = json.loads(line)
                kind = event.get("Event")
                if kind == "SparkListenerJobStart":
                    group = (event.get("Properties") or {}).get("spark.jobGroup.id")
                    if group:
                        for stage in event.get("Stage IDs", []):
                            stage_group[stage] = group
                elif kind == "SparkListenerTaskEnd":
                    group = stage_group.get(event.get("Stage ID"))
                    metrics = event.get("Task Metrics") or {}
                    moved = (metrics.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    if group and moved:
                        written[group] = written.get(group, 0) + moved
    return written


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [k for k in os.environ.get("BENCH_ONLY", "").split(",") if k]
    scratch = os.environ.get("BENCH_SCRATCH") or f"/tmp/shelfwise-bench-{uuid.uuid4().hex[:8]}"
    event_dir = os.path.join(scratch, "events")
    os.makedirs(event_dir, exist_ok=True)
    os.environ["SHELFWISE_EVENT_LOG_DIR"] = event_dir
    partitions = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", max(8, 2 * cpus)))
    spark = local_session(cores=cpus, shuffle_partitions=partitions, app="shelfwise-bench")
    root = os.environ.get("BENCH_WAREHOUSE") or os.path.join(ensure_checkpoint_dir(spark),
                                                             f"bench-warehouse-{uuid.uuid4().hex[:8]}")
    t0 = time.perf_counter()
    write_warehouse(testdata.load(spark, sf_dir, PR.as_of), root)
    prepare = time.perf_counter() - t0
    tables = from_warehouse(spark, root)
    timings = {}
    for key, job in HEADLINE.items():
        if only and key not in only:
            continue
        run_once(job(tables))
        spark.sparkContext.setJobGroup(key, key)
        timings[key] = round(statistics.median(run_once(job(tables)) for _ in range(runs)), 3)
        spark.sparkContext.setJobGroup("idle", "idle")
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    conf = {"spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}
    spark.stop()
    try:
        shuffled = shuffle_bytes_by_group(event_dir)
    except Exception as exc:  # metrics are optional; the timings are the result
        print(f"shuffle metrics unavailable: {exc}", file=sys.stderr)
        shuffled = {}
    print(json.dumps({
        "metric": "sum_of_median_job_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
        "prepare_warehouse_sec": round(prepare, 3),
        "shuffle_bytes_per_run": {k: shuffled.get(k, 0) // runs for k in timings},
        **conf,
    }))


if __name__ == "__main__":
    main()
