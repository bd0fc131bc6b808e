"""Current stock health (B3), stock-health trend (B4) and bucket totals."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.exprs import floor_nonpositive
from ..functions.rules import BUCKET_COLUMNS, coverage_buckets
from ..operators.relational import (
    class_wide, exclude_parents, membership_flag, report_order, with_categories, with_name,
)
from ..sources.tables import Tables

HEALTH_CLASSES = [
    (P.YEAR_IN_STOCK, "mean", "_m365_is"),
    (P.D42_IN_STOCK, "mean", "_m42_is"),
    (P.WEEK_IN_STOCK, "mean", "_m7_is"),
    (P.YEAR_SALES, "label", "SALES_CLASS_YEAR"),
    (P.D42_SALES, "label", "SALES_CLASS_LAST_42_DAYS"),
]


def _estimated_days(stock, mean42):
    return F.when(mean42 <= 0, F.lit(0.0)).otherwise(stock / mean42)


def _stock_value(cost, stock):
    return F.round(cost * stock, 2).cast("decimal(18,2)")


def stock_health_base(t: Tables) -> DataFrame:
    """B3.1-B3.6: one row per stocked non-parent product (and label), de-duplicated."""
    stocked = exclude_parents(t.products.where(F.col("stock_magento") > 0), t.set_items)
    df = with_name(stocked, t.manufacturers, "manufacturer_id", "manufacturer_id", "BRAND")
    labels = t.product_labels.select(F.col("product_id").alias("_lpid"), F.col("label").alias("_label"))
    df = df.join(labels, df.product_id == labels._lpid, "left").drop("_lpid")
    df = membership_flag(df, t.clearance_products, "IS_SUPER_SALES_ITEM")
    df = with_name(df, t.suppliers, "supplier_id", "default_supplier_id", "_supplier")
    cls = class_wide(t.classifications, HEALTH_CLASSES).withColumnRenamed("product_id", "_cpid")
    df = df.join(cls, df.product_id == cls._cpid, "left").drop("_cpid")
    df = with_categories(df, t.categories)
    m42 = F.col("_m42_is")
    return df.select(
        F.col("product_id").alias("PRODUCT_ID"),
        F.col("name_nl").alias("PRODUCT_NAME"),
        "SALES_CLASS_YEAR",
        "SALES_CLASS_LAST_42_DAYS",
        floor_nonpositive(F.col("_m365_is")).cast("double").alias("AVG_SALES_IN_STOCK_365_DAYS"),
        floor_nonpositive(m42).cast("double").alias("AVG_SALES_IN_STOCK_42_DAYS"),
        floor_nonpositive(F.col("_m7_is")).cast("double").alias("AVG_SALES_IN_STOCK_7_DAYS_DAYS"),
        F.coalesce(F.col("_label"), F.lit("NONE")).alias("LABEL"),
        F.col("status").alias("ZICHTBAARHEID"),
        "IS_SUPER_SALES_ITEM",
        "BRAND",
        "CATEGORY",
        "ROOT_CATEGORY",
        F.coalesce(F.col("_supplier"), F.lit("NONE")).alias("DEFAULT_SUPPLIER"),
        F.col("cost_net").alias("PER_UNIT_COST"),
        F.col("stock_magento").alias("STOCK_MAGENTO"),
        _estimated_days(F.col("stock_magento"), m42).alias("ESTIMATED_STOCK_DAYS"),
        _stock_value(F.col("cost_net"), F.col("stock_magento")).alias("STOCK_VALUE"),
    ).distinct()


def with_buckets(df: DataFrame, p: P.StockHealthParams = P.StockHealthParams()) -> DataFrame:
    """B3.7-B3.13 (shared with the trend job): the seven bucket columns."""
    return df.withColumns(coverage_buckets(
        F.col("STOCK_VALUE"), F.col("AVG_SALES_IN_STOCK_42_DAYS"),
        F.col("AVG_SALES_IN_STOCK_365_DAYS"), F.col("ESTIMATED_STOCK_DAYS"), p.bucket_bounds))


def stock_health(t: Tables, p: P.StockHealthParams = P.StockHealthParams(),
                 sort: bool = True) -> DataFrame:
    """Stock value per product spread over days-of-cover buckets, largest first."""
    out = with_buckets(stock_health_base(t), p)
    return out.orderBy(*report_order("STOCK_VALUE", "PRODUCT_ID")) if sort else out


def current_snapshot(t: Tables, snapshot_date: dt.date) -> DataFrame:
    """Today's stock-health rows (B3 without buckets) stamped with the snapshot date, as
    ``sources.snapshots`` stores them for the trend."""
    return stock_health_base(t).withColumn("snapshot_date", F.lit(snapshot_date))


def stock_health_trend(snapshots: DataFrame, p: P.StockHealthParams = P.StockHealthParams()) -> DataFrame:
    """Every snapshot row with the seven bucket columns (a narrow projection)."""
    return with_buckets(snapshots, p)


def bucket_totals(t: Tables, p: P.StockHealthParams = P.StockHealthParams()) -> DataFrame:
    """Bucket sums per sales class and category, with class and grand totals
    (the grouping sets of ROLLUP(class, category)).

    ``LEVEL`` is the grouping id: 0 class and category, 1 class total, 3 grand total.
    The base is planned once. One marker row without values joins it before the rollup,
    so the grand total has its row even when no product is stocked, as SQL's ROLLUP does
    (Spark's ``rollup`` returns no row for empty input); a group of the marker alone goes.
    Each bucket is fixed to 6 decimals before summing, so the sum does not depend on
    the order in which the rows arrive.
    """
    df = stock_health(t, p, sort=False)
    sums = [F.sum("STOCK_VALUE").cast("decimal(38,2)").alias("STOCK_VALUE"),
            *[F.sum(F.col(c).cast("decimal(38,6)")).cast("decimal(38,6)").alias(c) for c in BUCKET_COLUMNS]]
    keys = ["SALES_CLASS_YEAR", "CATEGORY"]
    rows = df.select(*keys, "STOCK_VALUE", *BUCKET_COLUMNS, F.lit(1).alias("_rows"))
    marker = df.sparkSession.range(1).select(F.lit(0).alias("_rows"))
    rolled = (rows.unionByName(marker, allowMissingColumns=True).rollup(*keys)
              .agg(*sums, F.sum("_rows").alias("_rows"), F.grouping_id().cast("int").alias("LEVEL"))
              .where((F.col("LEVEL") == 3) | (F.col("_rows") > 0)))
    return rolled.select(*keys, "LEVEL", "STOCK_VALUE", *BUCKET_COLUMNS)
