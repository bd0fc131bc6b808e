"""Run one job over a warehouse and write its result.

    spark-submit --py-files shelfwise.zip run_job.py \\
        margin --warehouse /shared/warehouse --as-of 2022-06-30 --out /shared/out/cm_base

or, where pyspark is installed, ``python -m shelfwise margin ...``.

The session comes from the cluster (``SparkSession.builder.getOrCreate()``); the
correctness and scale settings of ``shelfwise.conf`` are applied to it. Results are
written as Parquet with ``mode("overwrite")``, so a failed run can be repeated.
"""

from __future__ import annotations

import argparse
import datetime as dt
from dataclasses import replace

from pyspark.sql import SparkSession

from .conf import apply_cluster_conf, apply_conf
from .params import TESTDATA_PROFILE, Profile, report_profile
from .plans import bundles, expected_sales, history, margin, purchase, replenishment, shipping, stock_health
from .sources import snapshots
from .sources.tables import from_warehouse
from .sources.validate import key_violations

# job name -> function of (Tables, Profile)
JOBS = {
    "margin": lambda t, pr: margin.contribution_margin(t, pr.margin),
    "margin-shipping-allocation": lambda t, pr: margin.allocated_shipping_cost(t, pr.margin),
    "replenishment": lambda t, pr: replenishment.replenishment_list(t, pr.replenishment),
    "purchase-check": lambda t, pr: replenishment.purchase_check(t, pr.replenishment),
    "low-stock-report": lambda t, pr: replenishment.low_stock_report(t, pr.replenishment),
    "stock-health": lambda t, pr: stock_health.stock_health(t, pr.stock_health),
    "stock-health-totals": lambda t, pr: stock_health.bucket_totals(t, pr.stock_health),
    "expected-sales-leaf-blowers": lambda t, pr: expected_sales.seasonal_expected_sales(t, pr.leaf_blower),
    "expected-sales-lamps": lambda t, pr: expected_sales.seasonal_expected_sales(t, pr.lamps),
    "expected-sales-horizon": lambda t, pr: expected_sales.horizon_expected_sales(t, pr.horizon),
    "shipped-child-quantities": lambda t, pr: bundles.shipped_child_quantities(t, pr.shipped_child),
    "purchase-value": lambda t, pr: purchase.purchase_value(t, pr.purchase_value),
    "open-purchase-quantities": lambda t, pr: purchase.open_purchase_quantities(t),
    "open-purchase-values": lambda t, pr: purchase.open_purchase_values(t),
    "current-stock": lambda t, pr: purchase.current_stock(t),
    "stock-value-totals": lambda t, pr: purchase.stock_value_totals(t),
    "out-of-stock": lambda t, pr: history.out_of_stock_base(t, pr.out_of_stock),
    "out-of-stock-percentage": lambda t, pr: history.out_of_stock_percentage(t, pr.out_of_stock),
    "stock-development": lambda t, pr: history.stock_development(t),
    "stock-value-per-class": lambda t, pr: history.stock_value_per_class(t),
    "shipping-lines": lambda t, pr: shipping.shipping_lines(t, pr.shipping_time),
    "class-shares": lambda t, pr: shipping.class_shares(t, pr.shipping_time),
    "shipped-within": lambda t, pr: shipping.shipped_within(t, pr.shipping_time),
    "key-violations": lambda t, pr: key_violations(t),
    "stock-health-snapshot": None,   # writes one day of the snapshot table (see main)
    "stock-health-trend": None,      # trend over a stored snapshot table (see main)
}


def profile_for(as_of: dt.date, testdata: bool, year: int | None = None, season_year: int | None = None) -> Profile:
    """The profile's constants; ``year`` moves the margin base, the shipped child quantities
    and the purchase value, ``season_year`` the two seasonal reports."""
    pr = replace(TESTDATA_PROFILE, as_of=as_of) if testdata else report_profile(as_of)
    if year is not None:
        pr = replace(pr, margin=replace(pr.margin, from_year=year), shipped_child=replace(pr.shipped_child, year=year),
                     purchase_value=replace(pr.purchase_value, year=year))
    if season_year is not None:
        pr = replace(pr, leaf_blower=replace(pr.leaf_blower, year=season_year),
                     lamps=replace(pr.lamps, year=season_year))
    return pr


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="shelfwise", description=__doc__,
                                 formatter_class=argparse.RawDescriptionHelpFormatter)
    ap.add_argument("job", choices=sorted(JOBS))
    ap.add_argument("--warehouse", required=True, help="folder with one Parquet dataset per logical table")
    ap.add_argument("--as-of", required=True, type=dt.date.fromisoformat, help="run date (YYYY-MM-DD)")
    ap.add_argument("--out", required=True, help="output folder (Parquet, overwritten)")
    ap.add_argument("--testdata-years", action="store_true",
                    help="use the years of the test profile instead of the report's")
    ap.add_argument("--year", type=int,
                    help="year of the margin, shipped-child-quantities and purchase-value jobs")
    ap.add_argument("--season-year", type=int, help="year of the seasonal expected-sales jobs")
    ap.add_argument("--snapshots", help="snapshot table folder (stock-health-trend)")
    ap.add_argument("--largest-shuffle-gb", type=float,
                    help="size shuffle partitions for this much data in the largest shuffle")
    args = ap.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if args.largest_shuffle_gb:
        apply_cluster_conf(spark, int(args.largest_shuffle_gb * 2**30))
    else:
        apply_conf(spark)
    tables = from_warehouse(spark, args.warehouse)
    profile = profile_for(args.as_of, args.testdata_years, args.year, args.season_year)
    if args.job == "stock-health-snapshot":
        # replaces only the as-of day's partition of the snapshot table at --out
        snapshots.write_snapshot(stock_health.current_snapshot(tables, args.as_of), args.out)
        return
    if args.job == "stock-health-trend":
        if not args.snapshots:
            ap.error("stock-health-trend needs --snapshots")
        df = stock_health.stock_health_trend(snapshots.read_snapshots(spark, args.snapshots), profile.stock_health)
    else:
        df = JOBS[args.job](tables, profile)
    df.write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
