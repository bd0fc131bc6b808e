"""Shipped quantities per child product, with bundles exploded (B8, B8.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.relational import report_order
from ..params import ShippedChildParams
from ..sources.tables import Tables

GROUP = ("product_id", "root_category", "category", "country")


def _eligible_line_groups(t: Tables, p: ShippedChildParams) -> DataFrame:
    """Shipped lines of the year and websites, pre-summed per product and group.

    Both branches of the report read these lines; summing them once per (product,
    root_category, category, country, is-bundle) before the bundle join means the
    join and the final regrouping see one row per product group, and a product that
    holds a large share of the lines is combined map-side before any shuffle.
    """
    lines = t.order_lines.where(
        (F.col("status") == p.status) & (F.col("year_number") == p.year)
        & (F.col("order_type") == p.order_type) & F.col("website_id").isin(*p.websites)
        & (F.col("product_id") > 0))
    country = F.when(F.col("website_id") == p.home_website, F.lit(p.home_country)).otherwise(F.lit(p.other_country))
    return (lines.withColumn("country", country)
            .groupBy(*GROUP, (F.col("line_type") == p.composition_line_type).alias("_is_bundle"))
            .agg(F.max("description").alias("product_name"), F.sum("qty").alias("quantity_sold")))


def sold_products(groups: DataFrame, set_items: DataFrame, direct: bool = True) -> DataFrame:
    """The products that each group stands for: the product itself when it is no parent
    (``direct``), the children of a sold bundle (B8.1) with quantity x bridge quantity.

    The bridge becomes one row per parent with its children as an array, so one join
    answers both whether a product is a parent and which children it has, and one
    ``explode`` turns a group into its output rows: the lines are scanned once. As in
    SQL's NOT IN, a NULL parent in the bridge leaves no direct row.
    """
    bridge = (set_items.where(F.col("parent_product_id").isNotNull())
              .groupBy(F.col("parent_product_id").alias("_parent"))
              .agg(F.collect_list(F.struct(F.col("child_product_id").alias("id"), F.col("quantity").alias("per")))
                   .alias("_children")))
    joined = groups.join(bridge, groups.product_id == bridge._parent, "left")
    outputs = F.when(F.col("_is_bundle"), F.col("_children"))
    if direct:
        null_parents = set_items.select(F.count(F.when(F.col("parent_product_id").isNull(), 1))).scalar()
        itself = F.array(F.struct(F.col("product_id").alias("id"), F.lit(1).cast("long").alias("per")))
        outputs = F.when(F.col("_children").isNotNull(), outputs).otherwise(F.when(null_parents == 0, itself))
    return (joined.withColumn("_sold", F.explode(outputs))
            .select(F.col("_sold.id").alias("product_id"), "product_name", "root_category", "category", "country",
                    (F.col("quantity_sold") * F.col("_sold.per")).alias("quantity_sold")))


def _per_product(rows: DataFrame) -> DataFrame:
    return (rows.groupBy(*GROUP).agg(F.max("product_name").alias("product_name"),
                                     F.sum("quantity_sold").alias("quantity_sold"))
            .select("product_id", "product_name", "root_category", "category", "country", "quantity_sold"))


def bundle_child_quantities(t: Tables, p: ShippedChildParams = ShippedChildParams()) -> DataFrame:
    """B8.1 on its own: the bundle lines of the year exploded to their children and
    summed per child product, category and country."""
    return _per_product(sold_products(_eligible_line_groups(t, p), t.set_items, direct=False))


def shipped_child_quantities(t: Tables, p: ShippedChildParams = ShippedChildParams(),
                             sort: bool = True) -> DataFrame:
    """Direct lines of non-parent products plus bundle lines exploded to their
    children, summed per child product, category and country."""
    out = _per_product(sold_products(_eligible_line_groups(t, p), t.set_items))
    if not sort:
        return out
    return out.orderBy(*report_order("quantity_sold", "product_id", "country", "category", "root_category"))
