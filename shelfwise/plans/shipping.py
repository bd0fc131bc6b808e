"""Order lines for shipping time and revenue (B13) and the class shares built on
them (D1 revenue / product / order share, D2 orders shipped within n days)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions.exprs import safe_ratio, yes_no
from ..operators.relational import join_slice
from ..sources.tables import Tables


def shipping_lines(t: Tables, p: P.ShippingTimeParams) -> DataFrame:
    """Sales and follow-up lines of this and last year with the yearly class."""
    first_year = p.as_of.year - p.years_back
    lines = t.order_lines.where(
        F.col("order_type").isin(*p.order_types) & (F.col("status") >= p.min_status)
        & (F.col("order_date") >= F.lit(dt.date(first_year, 1, 1)))
        & (F.col("product_id") > 0) & (F.col("qty") > 0))
    lines = join_slice(lines, t.classifications, P.YEAR_SALES, {"label": "sales_class"})
    return lines.select(
        "product_id",
        F.col("order_id").alias("ORDER_ID"),
        "day_name",
        "qty",
        "sales_class",
        yes_no(F.col("day_name").isin(*p.weekend_days)).alias("IS_WEEKEND"),
        F.to_date("order_date").alias("order_date"),
        "line_total_ex_vat",
        "shipped_in",
    )


def class_shares(t: Tables, p: P.ShippingTimeParams) -> DataFrame:
    """Revenue, distinct products and distinct orders per sales class, and each as a
    share of the total over all classes.

    The totals are one scalar subquery returning a struct (one global aggregate, whose
    distinct counts are partially aggregated before their shuffle), so no window or
    join moves the per-class rows to one task.
    """
    lines = shipping_lines(t, p)
    measures = [F.sum("line_total_ex_vat").cast("decimal(38,4)").alias("REVENUE"),
                F.countDistinct("product_id").alias("N_PRODUCTS"),
                F.countDistinct("ORDER_ID").alias("N_ORDERS")]
    per_class = lines.groupBy("sales_class").agg(*measures)
    total = lines.agg(*measures).select(F.struct("REVENUE", "N_PRODUCTS", "N_ORDERS")).scalar()
    return per_class.select(
        "sales_class", "REVENUE", "N_PRODUCTS", "N_ORDERS",
        safe_ratio(F.col("REVENUE"), total.getField("REVENUE")).alias("REVENUE_SHARE"),
        safe_ratio(F.col("N_PRODUCTS"), total.getField("N_PRODUCTS")).alias("PRODUCT_SHARE"),
        safe_ratio(F.col("N_ORDERS"), total.getField("N_ORDERS")).alias("ORDER_SHARE"),
    )


def shipped_within(t: Tables, p: P.ShippingTimeParams) -> DataFrame:
    """Per sales class, distinct orders with a line shipped within n days over all
    distinct orders."""
    lines = shipping_lines(t, p)
    fast = F.when(F.col("shipped_in") <= p.shipped_within_days, F.col("ORDER_ID"))
    agg = lines.groupBy("sales_class").agg(
        F.countDistinct(fast).alias("N_ORDERS_SHIPPED_WITHIN"),
        F.countDistinct("ORDER_ID").alias("N_ORDERS"),
    )
    return agg.withColumn("SHIPPED_WITHIN_SHARE",
                          safe_ratio(F.col("N_ORDERS_SHIPPED_WITHIN"), F.col("N_ORDERS")))
