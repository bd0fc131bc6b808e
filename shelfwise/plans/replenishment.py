"""Replenishment list (B2), its purchase CHECK flag (D9) and low-stock report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import rules
from ..functions.exprs import round_half_away, to_int_half_away, yes_no
from ..operators.relational import (
    OPEN_PO_ALL, class_wide, exclude_parents, membership_flag, merged, report_order, with_categories,
    with_name, with_not_in_truth, with_open_po,
)
from ..sources.tables import Tables

T1_COLUMNS = (
    "PRODUCT_ID", "SALES_CLASS", "SALES_CLASS_IN_STOCK_42_DAYS", "PRODUCT_NAME", "EAN", "LABEL",
    "ZICHTBAARHEID", "IS_SUPER_SALES_ITEM", "IS_AUTO_UIT_ITEM", "MOQ", "MIN_DESIRED_STOCK", "BRAND",
    "CATEGORY", "ROOT_CATEGORY", "DEFAULT_SUPPLIER", "PER_UNIT_COST", "REORDER_POINT_FACTOR",
    "AVG_SALES_LAST_7_DAYS", "AVG_SALES_LAST_42_DAYS", "AVG_SALES_LAST_365_DAYS", "AVG_SALES_QTY",
    "STOCK_MAGENTO", "TOTAL_ORDER_LAST_90_DAYS", "ORDER_DAYS", "CORRECTED_LEAD_TIME",
)
OUTPUT = T1_COLUMNS + ("ORDERED", "CONFIRMED", "BACKORDER", "RECEIVED", "REORDER_POINT",
                       "PRIMARY_QTY", "ORDER_QTY", "ORDER_VALUE")


def reorder_factors(t: Tables, p: P.ReplenishmentParams) -> DataFrame:
    """B2.1: share of the last 28 days with low stock, and 1 + that share as factor.

    A day is low unless stock > round(42-day mean x 5); a NULL stock or mean counts as
    low. The divisor is the window length even when fewer days are present.
    """
    since = p.as_of - dt.timedelta(days=p.factor_days)
    hist = t.product_history.where(F.col("date") > F.lit(since))
    # The same pivot as the candidate rows (a superset of the two slices needed here),
    # so within the replenishment list both uses share one aggregation.
    cls = class_wide(t.classifications, PRODUCT_CLASSES)
    # The history is inner-joined to these product rows on the key, so "not a parent"
    # is tested once per product here instead of once per history row.
    cls = exclude_parents(cls.where(F.col("SALES_CLASS").isin(*P.REORDER_CLASSES)), t.set_items, merge=True)
    cls = cls.withColumnRenamed("product_id", "_cpid")
    df = hist.join(merged(cls), hist.product_id == cls._cpid, "inner")
    threshold = round_half_away(F.col("_m42") * p.low_stock_days_of_sales, 0)
    low = F.sum(F.when(F.col("stock_magento") > threshold, 0).otherwise(1))
    agg = df.groupBy("product_id").agg(low.cast("long").alias("_low"))
    return agg.select(
        F.col("product_id").alias("PRODUCT_ID"),
        round_half_away(F.col("_low") * 100 / F.lit(p.factor_days), 2).alias("LOW_STOCK_PERCENTAGE_DAYS"),
        round_half_away(F.lit(1) + F.col("_low") / F.lit(p.factor_days), 2).alias("REORDER_POINT_FACTOR"),
    )


def order_counts(t: Tables, p: P.ReplenishmentParams) -> DataFrame:
    """B2.2: exact number of distinct sales orders per product in the last 90 days
    (no upper date bound, as in the report)."""
    since = p.as_of - dt.timedelta(days=p.order_count_days)
    lines = t.order_lines.where((F.col("order_date") >= F.lit(since)) & (F.col("qty") > 0)
                                & (F.col("product_id") > 0) & (F.col("order_type") == "sales_order"))
    return lines.groupBy("product_id").agg(F.countDistinct("order_id").alias("total_order_last_90_days"))


PRODUCT_CLASSES = [
    (P.WEEK_SALES, "mean", "_m7"),
    (P.D42_SALES, "mean", "_m42"),
    (P.D42_IN_STOCK, "label", "SALES_CLASS_IN_STOCK_42_DAYS"),
    (P.YEAR_SALES, "label", "SALES_CLASS"),
    (P.YEAR_SALES, "mean", "_m365"),
]


def candidates(t: Tables, p: P.ReplenishmentParams) -> DataFrame:
    """B2.3-B2.9: the wide product row of every replenishment candidate (report t1).

    The report's filter is ``(not a parent AND class rule) OR (label new AND the
    label's product is not a parent)``; the label join makes both arms test the same
    product, so it is applied as ``not a parent AND (class rule OR label new)``: one
    anti join instead of two nested-loop existence joins. The report also left-joins
    the bundle bridge with the product as parent; after the parent filter that join
    matches nothing and none of its columns is used, so it is left out.

    The lookups by product grow with the products and are merged: each under the broadcast
    limit, they are many, and the driver would hold them all.
    """
    prods = exclude_parents(t.products, t.set_items, merge=True)
    rpf = reorder_factors(t, p).select(F.col("PRODUCT_ID").alias("_rpid"),
                                       F.col("REORDER_POINT_FACTOR").alias("_raw_factor"))
    df = prods.join(merged(rpf), prods.product_id == rpf._rpid, "left").drop("_rpid")
    oc = order_counts(t, p).withColumnRenamed("product_id", "_opid")
    df = df.join(merged(oc), df.product_id == oc._opid, "left").drop("_opid")
    df = with_name(df, t.manufacturers, "manufacturer_id", "manufacturer_id", "BRAND")
    labels = t.product_labels.select(F.col("product_id").alias("_lpid"), F.col("label").alias("_label"))
    df = df.join(merged(labels), df.product_id == labels._lpid, "left").drop("_lpid")
    df = membership_flag(df, merged(t.clearance_products), "IS_SUPER_SALES_ITEM")
    moq = t.min_order_qty.select(F.col("product_id").alias("_moq_pid"), "minimum_qty")
    df = df.join(merged(moq), df.product_id == moq._moq_pid, "left")
    mdq = t.min_desired_qty.select(F.col("product_id").alias("_mdq_pid"), "minimum_desired_qty")
    df = df.join(merged(mdq), df.product_id == mdq._mdq_pid, "left")
    df = membership_flag(df, merged(t.auto_disable_products), "IS_AUTO_UIT_ITEM")
    df = with_name(df, t.suppliers, "supplier_id", "default_supplier_id", "_supplier")
    cls = class_wide(t.classifications, PRODUCT_CLASSES).withColumnRenamed("product_id", "_cpid")
    df = df.join(merged(cls), df.product_id == cls._cpid, "left").drop("_cpid")
    df = with_categories(df, t.categories)
    klass, label = F.col("SALES_CLASS"), F.col("_label")
    class_rule = klass.isin(*P.REORDER_CLASSES) | ((klass == "D") & (F.col("stock_magento") < 0))
    if p.exclude_black_friday:
        # the report's commented-out line adds "not a Black Friday product" to the class arm
        df = with_not_in_truth(df, "product_id", merged(t.bf_assortment_sales), "product_id", "_not_bf")
        class_rule = F.col("_not_bf") & class_rule
    df = df.where(class_rule | (label == P.NEW_LABEL))
    return df.select(
        F.col("product_id").alias("PRODUCT_ID"),
        "SALES_CLASS",
        "SALES_CLASS_IN_STOCK_42_DAYS",
        F.col("name_nl").alias("PRODUCT_NAME"),
        F.col("ean").alias("EAN"),
        F.coalesce(label, F.lit("NONE")).alias("LABEL"),
        F.col("status").alias("ZICHTBAARHEID"),
        "IS_SUPER_SALES_ITEM",
        "IS_AUTO_UIT_ITEM",
        F.when(F.col("_moq_pid").isNotNull(), to_int_half_away(F.col("minimum_qty")))
         .otherwise(F.lit(1).cast("long")).alias("MOQ"),
        F.when(F.col("_mdq_pid").isNotNull(), F.col("minimum_desired_qty"))
         .otherwise(F.lit(0).cast("long")).alias("MIN_DESIRED_STOCK"),
        "BRAND",
        "CATEGORY",
        "ROOT_CATEGORY",
        F.coalesce(F.col("_supplier"), F.lit("NONE")).alias("DEFAULT_SUPPLIER"),
        F.col("cost").alias("PER_UNIT_COST"),
        F.coalesce(F.col("_raw_factor"), F.lit(1.0)).alias("REORDER_POINT_FACTOR"),
        rules.rounded_mean_floor(F.col("_m7")).alias("AVG_SALES_LAST_7_DAYS"),
        rules.rounded_mean_floor(F.col("_m42")).alias("AVG_SALES_LAST_42_DAYS"),
        rules.rounded_mean_floor(F.col("_m365")).alias("AVG_SALES_LAST_365_DAYS"),
        rules.sales_rate(klass, label, F.col("_m7"), F.col("_m42"), p.rate_rule).alias("AVG_SALES_QTY"),
        F.col("stock_magento").alias("STOCK_MAGENTO"),
        F.coalesce(F.col("total_order_last_90_days"), F.lit(0).cast("long")).alias("TOTAL_ORDER_LAST_90_DAYS"),
        rules.order_days(F.col("status"), F.col("_supplier"), klass, label, p).alias("ORDER_DAYS"),
        rules.corrected_lead_time(F.col("_raw_factor"), F.col("_supplier"), p).alias("CORRECTED_LEAD_TIME"),
    )


def candidate_open_quantities(t: Tables, p: P.ReplenishmentParams) -> DataFrame:
    """B2.10 on its own: ordered / confirmed / backorder / received per candidate."""
    ids = candidates(t, p).select("PRODUCT_ID").distinct()
    return with_open_po(ids, t.pending_po, OPEN_PO_ALL, floor_negative=("RECEIVED",))


def replenishment_list(t: Tables, p: P.ReplenishmentParams, sort: bool = True) -> DataFrame:
    """B2: replenishment list with open quantities, reorder point and order quantity."""
    t1 = candidates(t, p)
    t6 = with_open_po(t1, t.pending_po, OPEN_PO_ALL, floor_negative=("RECEIVED",))
    t6 = t6.withColumn("REORDER_POINT", rules.reorder_point(
        F.col("SALES_CLASS"), F.col("CORRECTED_LEAD_TIME"), F.col("AVG_SALES_LAST_42_DAYS")))
    t6 = t6.select(*T1_COLUMNS, "ORDERED", "CONFIRMED", "BACKORDER", "RECEIVED", "REORDER_POINT").distinct()
    t7 = t6.withColumn("PRIMARY_QTY", rules.primary_qty(
        F.col("STOCK_MAGENTO"), F.col("REORDER_POINT"), F.col("IS_SUPER_SALES_ITEM"),
        F.col("IS_AUTO_UIT_ITEM"), F.col("ORDER_DAYS"), F.col("AVG_SALES_QTY")))
    open_qty = F.col("ORDERED") + F.col("CONFIRMED") + F.col("BACKORDER") + F.col("RECEIVED")
    t8 = t7.withColumn("ORDER_QTY", rules.order_qty_open_only(
        F.col("STOCK_MAGENTO"), open_qty, F.col("PRIMARY_QTY")).cast("double"))
    t9 = t8.withColumn("ORDER_VALUE", round_half_away(F.col("ORDER_QTY") * F.col("PER_UNIT_COST"), 0))
    return t9.orderBy(*report_order("ORDER_QTY", "PRODUCT_ID")) if sort else t9


def purchase_check(t: Tables, p: P.ReplenishmentParams) -> DataFrame:
    """CHECK = YES for an established product with an order suggestion but fewer
    than ``check_max_orders`` orders in the last 90 days."""
    b2 = replenishment_list(t, p, sort=False)
    check = ((F.col("LABEL") != P.NEW_LABEL) & (F.col("ORDER_QTY") > 0)
             & (F.col("TOTAL_ORDER_LAST_90_DAYS") < p.check_max_orders))
    return b2.select("PRODUCT_ID", "LABEL", "ORDER_QTY", "TOTAL_ORDER_LAST_90_DAYS",
                     yes_no(check).alias("CHECK"))


def low_stock_report(t: Tables, p: P.ReplenishmentParams) -> DataFrame:
    """Low-stock day percentage per product with its yearly class, highest first."""
    rpf = reorder_factors(t, p)
    cls = class_wide(t.classifications, [(P.YEAR_SALES, "label", "SALES_CLASS")]).withColumnRenamed(
        "product_id", "_cpid")
    out = rpf.join(merged(cls), rpf.PRODUCT_ID == cls._cpid, "left").drop("_cpid")
    return out.select("PRODUCT_ID", "SALES_CLASS", "LOW_STOCK_PERCENTAGE_DAYS", "REORDER_POINT_FACTOR") \
        .orderBy(*report_order("LOW_STOCK_PERCENTAGE_DAYS", "PRODUCT_ID"))
