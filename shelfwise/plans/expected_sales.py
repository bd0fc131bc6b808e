"""Expected sales and order quantities: seasonal per category pattern (B5, B6) and
over a horizon for one manufacturer (B7). B5.1 is ``rules.order_qty_with_stock``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.exprs import round_half_away
from ..functions.rules import order_qty_with_stock
from ..operators.relational import (
    OPEN_PO_CONF_BACK, class_wide, exclude_parents, report_order, with_name, with_open_po,
)
from ..sources.tables import Tables


def season_filter(column: str, year: int, months: tuple) -> Column:
    """year(c) = year AND month(c) IN months, as a timestamp range (pushed to the scan);
    a month test is added only when the months are not one contiguous run."""
    lo, hi = min(months), max(months)
    start = dt.date(year, lo, 1)
    end = dt.date(year + 1, 1, 1) if hi == 12 else dt.date(year, hi + 1, 1)
    cond = (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))
    if sorted(months) != list(range(lo, hi + 1)):
        cond = cond & F.month(F.col(column)).isin(*months)
    return cond


def like_any(column: str, patterns: tuple) -> Column:
    cond = None
    for pattern in patterns:
        c = F.col(column).like(pattern)
        cond = c if cond is None else cond | c
    return cond


def season_sales(t: Tables, s: P.SeasonParams) -> DataFrame:
    """B5 / B6 first step: last season's quantity and daily average per product row.

    Lines are summed per (product, brand, category, root_category) before the product
    and supplier lookups; the groups are then summed again on the report's keys, which
    gives the report's numbers while the joins see one row per product group.
    """
    lines = t.order_lines.where(season_filter("order_date", s.year, s.months)
                                & like_any("category", s.category_patterns))
    pre = lines.groupBy("product_id", "brand", "category", "root_category").agg(
        F.max("description").alias("_desc"), F.sum("qty").alias("_qty"))
    # "not a parent" depends on product_id only: tested per group, not per line
    pre = exclude_parents(pre, t.set_items)
    prods = t.products.select(F.col("product_id").alias("_pid"), "cost_net", "stock_magento",
                              "default_supplier_id")
    joined = pre.join(prods, pre.product_id == prods._pid, "left")
    joined = with_name(joined, t.suppliers, "supplier_id", "default_supplier_id", "DEFAULT_SUPPLIER")
    t1 = joined.groupBy(
        F.col("product_id").alias("PRODUCT_ID"), F.col("brand").alias("BRAND"), "DEFAULT_SUPPLIER",
        F.col("category").alias("CATEGORY"), F.col("root_category").alias("ROOT_CATEGORY"),
        F.col("cost_net").alias("COST_PER_UNIT"), F.col("stock_magento").alias("STOCK_MAGENTO"),
    ).agg(F.max("_desc").alias("DESCRIPTION"), F.sum("_qty").alias("TOTAL_QTY_SOLD_2021"))
    return t1.withColumn("AVG_SALES_PER_DAY",
                         round_half_away(F.col("TOTAL_QTY_SOLD_2021") / F.lit(s.days_in_season), 2))


def seasonal_expected_sales(t: Tables, s: P.SeasonParams, sort: bool = True) -> DataFrame:
    """Last season's sales per product as the quantity to have for the next one."""
    t4 = with_open_po(season_sales(t, s), t.pending_po, OPEN_PO_CONF_BACK)
    qty = order_qty_with_stock(F.col("STOCK_MAGENTO"), F.col("CONFIRMED") + F.col("BACKORDER"),
                               F.col("TOTAL_QTY_SOLD_2021"))
    out = t4.withColumn("ORDER_QTY", qty).withColumn(
        "ORDER_VALUE", F.round(F.col("ORDER_QTY") * F.col("COST_PER_UNIT"), 0).cast("decimal(38,0)"))
    out = out.select("PRODUCT_ID", "DESCRIPTION", "BRAND", "DEFAULT_SUPPLIER", "CATEGORY", "ROOT_CATEGORY",
                     "COST_PER_UNIT", "STOCK_MAGENTO", "TOTAL_QTY_SOLD_2021", "AVG_SALES_PER_DAY",
                     "CONFIRMED", "BACKORDER", "ORDER_QTY", "ORDER_VALUE")
    if s.only_orderable:
        out = out.where((F.col("DEFAULT_SUPPLIER") != P.EOL_SUPPLIER) & (F.col("ORDER_QTY") > 0))
    return out.orderBy(*report_order("ORDER_VALUE", "PRODUCT_ID", "CATEGORY", "ROOT_CATEGORY")) if sort else out


HORIZON_CLASSES = [
    (P.YEAR_SALES, "label", "SALES_CLASS_YEAR"),
    (P.YEAR_SALES, "absolute", "TOTAL_SALES_LAST_YEAR"),
    (P.YEAR_SALES, "mean", "_mean"),
    (P.YEAR_IN_STOCK, "absolute", "TOTAL_SALES_IN_STOCK_LAST_YEAR"),
    (P.YEAR_IN_STOCK, "mean", "_mean_in_stock"),
]


def horizon_candidates(t: Tables, h: P.HorizonParams = P.HorizonParams()) -> DataFrame:
    """B7 first step: one distinct row per product of the manufacturer that sold last
    year (and per label and root category), with its horizon quantity.

    The source joins every order line of the product only to read root_category and
    then removes the copies with DISTINCT; the same rows come from the distinct
    (product, root_category) pairs of the candidate products' lines.
    """
    makers = t.manufacturers.where(F.col("name") == h.manufacturer).select(
        F.col("manufacturer_id").alias("_mid"))
    prods = t.products.join(makers, t.products.manufacturer_id == makers._mid, "inner").drop("_mid")
    prods = exclude_parents(prods, t.set_items)
    cls = class_wide(t.classifications, HORIZON_CLASSES).withColumnRenamed("product_id", "_cpid")
    prods = (prods.join(cls, prods.product_id == cls._cpid, "inner").drop("_cpid")
             .where(F.col("TOTAL_SALES_LAST_YEAR") > 0))
    prods = with_name(prods, t.suppliers, "supplier_id", "default_supplier_id", "DEFAULT_SUPPLIER")
    labels = t.product_labels.select(F.col("product_id").alias("_lpid"), F.col("label").alias("_label"))
    prods = prods.join(labels, prods.product_id == labels._lpid, "left").drop("_lpid")
    wanted = prods.select(F.col("product_id").alias("product_id"))
    roots = (t.order_lines.join(wanted, "product_id", "left_semi")
             .select(F.col("product_id").alias("_rpid"), F.col("root_category").alias("ROOT_CATEGORY"))
             .distinct())
    prods = prods.join(roots, prods.product_id == roots._rpid, "left").drop("_rpid")
    t1 = prods.select(
        F.col("product_id").alias("PRODUCT_ID"),
        F.when(F.col("_label") == P.NEW_LABEL, F.col("_label")).otherwise(F.lit("default"))
         .alias("NEW_PRODUCT_OR_NOT"),
        F.col("name_nl").alias("PRODUCT_NAME"),
        F.col("cost").alias("PURCHASE_PRICE"),
        "DEFAULT_SUPPLIER",
        "ROOT_CATEGORY",
        "SALES_CLASS_YEAR",
        "TOTAL_SALES_LAST_YEAR",
        round_half_away(F.col("_mean"), 2).alias("AVG_DAILY_SALES_LAST_YEAR"),
        "TOTAL_SALES_IN_STOCK_LAST_YEAR",
        round_half_away(F.col("_mean_in_stock"), 2).alias("AVG_DAILY_SALES_WHILE_IN_STOCK"),
        F.col("stock_magento").alias("STOCK_MAGENTO"),
        round_half_away(F.col("_mean_in_stock") * h.horizon_days, 0).alias("PRIMARY_QTY"),
    ).distinct()
    return t1


def horizon_expected_sales(t: Tables, h: P.HorizonParams = P.HorizonParams(),
                           sort: bool = True) -> DataFrame:
    """In-stock daily mean x horizon days as the quantity to have, for the
    products of one manufacturer that sold last year."""
    t4 = with_open_po(horizon_candidates(t, h), t.pending_po, OPEN_PO_CONF_BACK)
    qty = order_qty_with_stock(F.col("STOCK_MAGENTO"), F.col("CONFIRMED") + F.col("BACKORDER"),
                               F.col("PRIMARY_QTY"))
    out = (t4.withColumn("ORDER_QTY", qty.cast("double"))
           .withColumn("ORDER_VALUE", round_half_away(F.col("ORDER_QTY") * F.col("PURCHASE_PRICE"), 0))
           .where((F.col("DEFAULT_SUPPLIER") != h.excluded_supplier) & (F.col("ORDER_QTY") > 0)))
    return out.orderBy(*report_order("ORDER_VALUE", "PRODUCT_ID", "ROOT_CATEGORY")) if sort else out
