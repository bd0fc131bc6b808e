"""Current stock listing (B11), open purchase quantities (B10), purchase value per
supplier and category (B9), and their value totals (D4, D5)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import OPEN_PO_ALL, exclude_parents, with_name, with_open_po
from ..params import PurchaseValueParams
from ..sources.tables import Tables


def current_stock(t: Tables) -> DataFrame:
    """Non-parent products with stock_magento >= 0."""
    stocked = t.products.where(F.col("stock_magento") >= 0)
    return (exclude_parents(stocked, t.set_items)
            .select("product_id", "stock_magento", "stock_hbs", "cost_net"))


def stock_value_totals(t: Tables) -> DataFrame:
    """Total value of the webshop stock and of the warehouse stock."""
    s = current_stock(t)
    return s.agg(
        F.sum(F.col("stock_magento") * F.col("cost_net")).cast("decimal(38,4)").alias("STOCK_MAGENTO_VALUE"),
        F.sum(F.col("stock_hbs") * F.col("cost_net")).cast("decimal(38,4)").alias("STOCK_HBS_VALUE"),
    )


def open_purchase_quantities(t: Tables) -> DataFrame:
    """Ordered / confirmed / backorder / received quantity per non-parent product."""
    base = exclude_parents(t.products, t.set_items).select(
        F.col("product_id").alias("PRODUCT_ID"), F.col("cost").alias("PER_UNIT_COST"))
    out = with_open_po(base, t.pending_po, OPEN_PO_ALL, floor_negative=("RECEIVED",))
    return out.select("PRODUCT_ID", "PER_UNIT_COST", "ORDERED", "CONFIRMED", "BACKORDER",
                      "RECEIVED").distinct()


def open_purchase_values(t: Tables) -> DataFrame:
    """Value (quantity x unit cost) of each open purchase status."""
    q = open_purchase_quantities(t)
    return q.agg(*[
        F.sum(F.col(name) * F.col("PER_UNIT_COST")).cast("decimal(38,4)").alias(f"{name}_VALUE")
        for name in ("ORDERED", "CONFIRMED", "BACKORDER", "RECEIVED")
    ])


def year_range(column: str, year: int):
    """``year(column) = year`` as a range the Parquet reader can push down."""
    return (F.col(column) >= F.lit(dt.date(year, 1, 1))) & (F.col(column) < F.lit(dt.date(year + 1, 1, 1)))


def purchase_value(t: Tables, p: PurchaseValueParams = PurchaseValueParams()) -> DataFrame:
    """Purchase value per default supplier, supplier type and category.

    The source sums per product first and then per supplier; one sum per final group
    is the same number. The lines are summed per (product, category) before the
    product and supplier lookups, so those joins see one row per product and category
    instead of one per order line (and a hot product is already combined map-side).
    """
    lines = t.order_lines.where(year_range("order_date", p.year) & (F.col("status") == p.status)
                                & (F.col("product_id") > 0) & (F.col("website_id") == p.website))
    per_product = lines.groupBy("product_id", "category").agg(F.sum("purchase_net").alias("_value"))
    prods = t.products.select(F.col("product_id").alias("_pid"), "default_supplier_id")
    joined = per_product.join(prods, per_product.product_id == prods._pid, "left")
    joined = with_name(joined, t.suppliers, "supplier_id", "default_supplier_id", "DEFAULT_SUPPLIER",
                       extra={"type": "_stype"})
    return (joined.groupBy("DEFAULT_SUPPLIER",
                           F.coalesce(F.col("_stype"), F.lit("unknown")).alias("SUPPLIER_TYPE"),
                           F.col("category").alias("CATEGORY"))
            .agg(F.sum("_value").cast("decimal(38,4)").alias("TOTAL_PURCHASE_VALUE")))
