"""Jobs over the daily product history: out-of-stock base (B12) and its daily
percentage (D3), daily stock development (B14) and its value per class (D6).

The history is products x days, the largest input after the order lines. Every
product-level condition is resolved on the product table first; the history is then
joined once, on product_id, to that (much smaller) eligible-product table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..operators.relational import (
    class_slice, class_wide, membership_flag, not_in_all, not_in_by_key, report_order,
    with_categories, with_name,
)
from ..sources.tables import Tables


def eligible_for_out_of_stock(t: Tables, p: P.OutOfStockParams) -> DataFrame:
    """Products the out-of-stock report follows, with their descriptive columns.

    Visible, not a parent, not auto-disabled, not on clearance, supplier not end of
    life, a yearly sales classification, and some 42-day classification (of either
    type) with a mean of at least ``min_mean_42``. The last rule is how the report's
    42-day join behaves: its ON clause tests the yearly row's type, so every 42-day
    row of the product matches once the yearly sales row exists.
    """
    prods = t.products.where(F.col("status") != P.HIDDEN_STATUS)
    prods = not_in_all(prods, "product_id", [(t.set_items, "parent_product_id"),
                                             (t.auto_disable_products, "product_id"),
                                             (t.clearance_products, "product_id")])
    prods = with_name(prods, t.suppliers, "supplier_id", "default_supplier_id", "_supplier")
    prods = prods.where(F.col("_supplier") != P.EOL_SUPPLIER)
    prods = with_name(prods, t.manufacturers, "manufacturer_id", "manufacturer_id", "BRAND")
    prods = with_categories(prods, t.categories)
    yearly = class_slice(t.classifications, P.YEAR_SALES, {"label": "SALES_CLASS_YEAR"})
    prods = prods.join(yearly, prods.product_id == yearly._cls_pid, "inner").drop("_cls_pid")
    moving = (t.classifications.where((F.col("period") == P.D42_SALES[0]) & (F.col("mean") >= p.min_mean_42))
              .select(F.col("product_id").alias("_mpid")))
    prods = prods.join(moving, prods.product_id == moving._mpid, "left_semi")
    return prods.select("product_id", "BRAND", "CATEGORY", "ROOT_CATEGORY", "SALES_CLASS_YEAR")


def out_of_stock_base(t: Tables, p: P.OutOfStockParams) -> DataFrame:
    """Daily stock of the followed products over the last ``history_days`` days.

    The report de-duplicates its output rows. An output row is a history row joined on
    product_id to one product row, and both are projections of the output row, so
    de-duplicating the two sides separately gives the same set: the shuffle for it
    carries the narrow history columns only, and the product side is small. It is dealt
    out before it meets the history, by a hash of its key, as Spark leaves out a shuffle by
    the key itself: its joins are by product too, and a task would hold their sorts beside
    those of the history. Its size is then known, so that it can be broadcast.
    """
    since = p.as_of - dt.timedelta(days=p.history_days)
    eligible = eligible_for_out_of_stock(t, p).withColumnRenamed("product_id", "_epid").distinct()
    eligible = eligible.repartition(F.xxhash64("_epid"))
    followed = eligible.select(F.col("_epid").alias("_fpid"))
    hist = (t.product_history.where(F.col("date") >= F.lit(since))
            .join(followed, F.col("product_id") == followed._fpid, "left_semi")
            .select("product_id", "date",
                    F.coalesce(F.col("stock_magento"), F.lit(0).cast("long")).alias("STOCK_MAGENTO"),
                    "cost_net")
            .distinct())
    joined = hist.join(eligible, hist.product_id == eligible._epid, "inner")
    return joined.select(
        F.col("product_id").alias("PRODUCT_ID"), "date", "BRAND", "CATEGORY", "ROOT_CATEGORY",
        "STOCK_MAGENTO", "cost_net", "SALES_CLASS_YEAR")


def out_of_stock_percentage(t: Tables, p: P.OutOfStockParams) -> DataFrame:
    """D3: share of followed products with no stock, per day and yearly class."""
    base = out_of_stock_base(t, p)
    return base.groupBy("date", "SALES_CLASS_YEAR").agg(
        F.count(F.lit(1)).alias("N_PRODUCTS"),
        F.sum(F.when(F.col("STOCK_MAGENTO") <= 0, 1).otherwise(0)).cast("long").alias("N_OUT_OF_STOCK"),
    ).withColumn("OUT_OF_STOCK_PCT", F.col("N_OUT_OF_STOCK") * 100 / F.col("N_PRODUCTS"))


def stock_development(t: Tables, sort: bool = True) -> DataFrame:
    """Daily stock value of stocked non-parent products with current dimensions.

    Whether a product is a parent is decided once for each product of the history, not for
    each of its days. As in B12, the de-duplication is applied to each side of the product_id joins (the
    narrow history rows, and every product-level lookup after projection) instead of
    to the wide output rows; the joins then cannot create duplicates.
    """
    hist = t.product_history.where(F.col("stock_magento") > 0)
    value = F.when(F.col("stock_magento") > 0, F.col("cost_net") * F.col("stock_magento")).otherwise(F.lit(0))
    # One shuffle of the narrow history rows serves the parent test, the de-duplication (equal
    # rows have equal products) and the lookups, whether these are broadcast or merged.
    hist = not_in_by_key(hist.select("product_id", "date", "cost_net", "stock_magento"), "product_id",
                         t.set_items, "parent_product_id").distinct()
    hist = hist.select(
        "product_id", F.col("date").alias("DATE"), F.col("cost_net").alias("PER_UNIT_COST"),
        F.col("stock_magento").alias("STOCK_MAGENTO"),
        F.round(value, 2).cast("decimal(18,2)").alias("STOCK_VALUE"),
    )
    prods = t.products.select(F.col("product_id").alias("_ppid"), "manufacturer_id", "main_category_id")
    prods = with_name(prods, t.manufacturers, "manufacturer_id", "manufacturer_id", "BRAND")
    prods = with_categories(prods, t.categories).select("_ppid", "BRAND", "CATEGORY", "ROOT_CATEGORY").distinct()
    df = hist.join(prods, hist.product_id == prods._ppid, "left").drop("_ppid")
    labels = t.product_labels.select(F.col("product_id").alias("_lpid"),
                                     F.coalesce(F.col("label"), F.lit("NONE")).alias("_label")).distinct()
    df = df.join(labels, df.product_id == labels._lpid, "left").drop("_lpid")
    df = membership_flag(df, t.clearance_products_hist, "IS_SUPER_SALES_ITEM")
    cls = class_wide(t.classifications, [(P.YEAR_SALES, "label", "SALES_CLASS_YEAR"),
                                         (P.D42_SALES, "label", "SALES_CLASS_LAST_42_DAYS")])
    cls = cls.withColumnRenamed("product_id", "_cpid")
    df = df.join(cls, df.product_id == cls._cpid, "left").drop("_cpid")
    out = df.select(
        F.col("product_id").alias("PRODUCT_ID"),
        "DATE",
        "SALES_CLASS_YEAR",
        "SALES_CLASS_LAST_42_DAYS",
        "BRAND",
        "CATEGORY",
        "ROOT_CATEGORY",
        F.coalesce(F.col("_label"), F.lit("NONE")).alias("LABEL"),
        "IS_SUPER_SALES_ITEM",
        "PER_UNIT_COST",
        "STOCK_MAGENTO",
        "STOCK_VALUE",
    )
    return out.orderBy(*report_order("STOCK_VALUE", "PRODUCT_ID", "DATE")) if sort else out


def stock_value_per_class(t: Tables) -> DataFrame:
    """Stock value per day and yearly sales class."""
    dev = stock_development(t, sort=False)
    return dev.groupBy("DATE", "SALES_CLASS_YEAR").agg(
        F.sum("STOCK_VALUE").cast("decimal(38,2)").alias("STOCK_VALUE"),
        F.count(F.lit(1)).alias("N_ROWS"))
