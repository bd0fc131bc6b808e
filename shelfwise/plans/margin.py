"""Contribution-margin base per order line (B1) and shipping cost allocated to lines.

Plan shape: the product lookups become one table, aggregated once. An order's groups
(order, website, shipping method) are rolled up from the order columns of the lines and a
small table (product, number of lookup rows, parcel flag): a line counts as often as its
lookup rows would repeat it, so that pass needs no names, rates or classes. The rollup is
joined to the lines on order_id, which keeps the report's fan-out (an order with two
website/method groups gives each line twice), so it is a real join and not a window; the
lookup rows come last, so that only the lines' own columns are shuffled. A hot order or
product is split on the line side by AQE's skew-join handling.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from ..functions import rules
from ..operators.relational import class_slice
from ..sources.tables import Tables

MONEY2 = "decimal(18,2)"  # per-line commissions, rounded to cents

OUTPUT = (
    "order_id", "order_date", "product_id", "product_name_nl", "sales_class", "brand", "category",
    "root_category", "qty", "website_id", "status", "channel", "country", "shipping_method",
    "shipping_cost_per_shipping_method", "order_line", "line_total", "line_total_ex_vat",
    "margin_total_net", "total_revenue_for_cost_share", "order_line_details", "mktplace_marketing_cost",
    "revenue_applicable_for_payment_cost", "cost_fraction",
)


def product_facts(t: Tables) -> DataFrame:
    """(facts): per product its names, commissions, yearly classes and separate-parcel marks,
    one array of (id, kind, text, rate).

    The four tables are read as one and grouped by product in one shuffle; both uses below
    read that same grouping. The id is taken from the facts: a join on it then has an
    exchange of its own on this side when it is too large to broadcast, without which AQE
    cannot split a hot product.
    """
    classes = class_slice(t.classifications, P.YEAR_SALES, {"label": "label"})
    parts = [t.products.select("product_id", F.lit("name").alias("kind"), F.col("name_nl").alias("text")),
             t.channel_commission.select("product_id", F.lit("rate").alias("kind"),
                                         F.col("commission_percentage").alias("rate")),
             classes.select(F.col("_cls_pid").alias("product_id"), F.lit("class").alias("kind"),
                            F.col("label").alias("text")),
             t.separate_parcel_products.select("product_id", F.lit("parcel").alias("kind"))]
    facts = parts[0]
    for part in parts[1:]:
        facts = facts.unionByName(part, allowMissingColumns=True)
    return (facts.where(F.col("product_id").isNotNull()).groupBy("product_id")
            .agg(F.collect_list(F.struct(F.col("product_id").alias("id"), "kind", "text", "rate")).alias("facts"))
            .select("facts"))


def _of_kind(kind: str) -> Column:
    return F.filter("facts", lambda f: f["kind"] == kind)


def product_weights(t: Tables) -> DataFrame:
    """(id, weight, parcel): how many lookup rows a line of the product meets, and whether it
    goes as a parcel of its own.

    A product with n names, m commissions and k class rows has max(n,1) * max(m,1) *
    max(k,1) rows, as many as chained left joins give one line.
    """
    rows = [F.greatest(F.size(_of_kind(kind)), F.lit(1)).cast("long") for kind in ("name", "rate", "class")]
    return product_facts(t).select(F.col("facts")[0]["id"].alias("id"), (rows[0] * rows[1] * rows[2]).alias("weight"),
                                   (F.size(_of_kind("parcel")) > 0).alias("parcel"))


def product_rows(t: Tables) -> DataFrame:
    """(id, product_name_nl, commission_percentage, sales_class, parcel): the lookup rows."""
    df = product_facts(t).select(F.col("facts")[0]["id"].alias("id"), (F.size(_of_kind("parcel")) > 0).alias("parcel"),
                                 *[_of_kind(kind).alias(f"_{kind}") for kind in ("name", "rate", "class")])
    for kind, field, name in (("name", "text", "product_name_nl"), ("rate", "rate", "commission_percentage"),
                              ("class", "text", "sales_class")):
        df = df.withColumn("_one", F.explode_outer(f"_{kind}")).withColumn(name, F.col(f"_one.{field}")).drop("_one", f"_{kind}")
    return df


def selected_lines(t: Tables, p: P.MarginParams) -> DataFrame:
    """The order lines the margin base covers, with their own columns only."""
    return t.order_lines.where(
        ~F.col("product_id").isin(*p.excluded_products)
        & (F.col("order_type") == p.order_type) & (F.col("status") >= p.min_status) & (F.col("qty") > 0)
        & (F.col("order_date") >= F.lit(dt.date(p.from_year, 1, 1)))
        & F.col("channel").isin(*p.channels) & F.col("website_id").isin(*p.websites))


def with_lookups(lines: DataFrame, t: Tables) -> DataFrame:
    """Lines (and what was joined to them) with product name, yearly class, marketplace
    commissions and the separate-parcel flag, once for each lookup row of the product."""
    found = product_rows(t)
    df = lines.join(found, lines.product_id == found.id, "left").drop("id")
    c = F.col
    return df.withColumns({
        "order_date": F.to_date("order_date"),
        "country": rules.country(c("website_id")),
        "bol_fixed_cost_per_product": rules.bol_fixed_commission(
            c("channel"), c("product_id"), c("line_total"), c("qty")).cast(MONEY2),
        "bol_variable_cost_per_product": rules.bol_variable_commission(
            c("channel"), c("product_id"), c("line_total"), c("commission_percentage")).cast(MONEY2),
        "ManoMano_marketing_cost_per_product": rules.manomano_commission(
            c("channel"), c("product_id"), c("brand"), c("line_total_ex_vat")).cast(MONEY2),
        "Amazon_marketing_cost_per_product": rules.amazon_commission(
            c("channel"), c("product_id"), c("line_total_ex_vat")).cast(MONEY2),
        "is_coll_product": F.when(c("parcel"), 1).otherwise(0),
    })


def eligible_lines(t: Tables, p: P.MarginParams = P.MarginParams()) -> DataFrame:
    """B1.1-B1.9: eligible lines with product name, yearly class, marketplace
    commissions and the separate-parcel flag."""
    return with_lookups(selected_lines(t, p), t).select(
        "order_id", "order_date", "product_id", "product_name_nl", "sales_class", "brand", "category",
        "root_category", "line_total", "line_total_ex_vat", "margin_total_net", "qty", "website_id", "channel",
        "country", "shipping_method", "status", "bol_fixed_cost_per_product", "bol_variable_cost_per_product",
        "ManoMano_marketing_cost_per_product", "Amazon_marketing_cost_per_product", "is_coll_product")


def order_rollup(t: Tables, p: P.MarginParams = P.MarginParams()) -> DataFrame:
    """B1.10-B1.11: per (order, website, shipping method): positive lines, revenue for
    the cost share, separate-parcel lines and the shipping cost. A line weighs as many
    lines as its product has lookup rows, which is what it is after the lookups."""
    lines = selected_lines(t, p).select("order_id", "website_id", "shipping_method", "product_id", "line_total_ex_vat")
    weights = product_weights(t)
    lines = lines.join(weights, lines.product_id == weights.id, "left")
    weight = F.coalesce(F.col("weight"), F.lit(1))
    positive = F.col("product_id") > 0
    revenue = F.col("line_total_ex_vat") * weight.cast("decimal(10,0)")
    agg = lines.groupBy("order_id", "website_id", "shipping_method").agg(
        F.sum(F.when(positive, weight).otherwise(0)).cast("long").alias("order_line"),
        F.sum(F.when(positive & (F.col("line_total_ex_vat") > 0), revenue).otherwise(F.lit(0)))
         .cast("decimal(38,4)").alias("total_revenue_for_cost_share"),
        F.sum(F.when(F.col("parcel"), weight).otherwise(0)).cast("long").alias("is_tm_colli"),
    )
    return agg.withColumn("shipping_cost_per_shipping_method", rules.shipping_cost(
        F.col("shipping_method"), F.col("website_id"), F.col("is_tm_colli"), F.col("order_line"))
        .cast("decimal(18,2)"))


def contribution_margin(t: Tables, p: P.MarginParams = P.MarginParams()) -> DataFrame:
    """B1: one row per eligible line (per rollup group of its order) with the cost base."""
    lines = selected_lines(t, p)
    rollup = order_rollup(t, p).select(
        F.col("order_id").alias("_oid"), "order_line", "total_revenue_for_cost_share",
        "shipping_cost_per_shipping_method").where(F.col("total_revenue_for_cost_share") != 0)
    df = with_lookups(lines.join(rollup, lines.order_id == rollup._oid).drop("_oid"), t)
    c = F.col
    return df.select(
        "order_id", "order_date", "product_id", "product_name_nl", "sales_class", "brand", "category",
        "root_category", "qty", "website_id", "status", "channel", "country", "shipping_method",
        "shipping_cost_per_shipping_method", "order_line", "line_total", "line_total_ex_vat",
        "margin_total_net", "total_revenue_for_cost_share",
        rules.order_line_class(c("product_id"), c("order_line"), c("qty")).alias("order_line_details"),
        rules.marketplace_cost(c("channel"), c("bol_fixed_cost_per_product"), c("bol_variable_cost_per_product"),
                               c("ManoMano_marketing_cost_per_product"), c("Amazon_marketing_cost_per_product"))
             .cast("decimal(18,2)").alias("mktplace_marketing_cost"),
        rules.payment_cost_revenue(c("channel"), c("line_total_ex_vat")).cast("decimal(18,4)")
             .alias("revenue_applicable_for_payment_cost"),
        rules.cost_fraction(c("product_id"), c("line_total_ex_vat"), c("total_revenue_for_cost_share"))
             .alias("cost_fraction"),
    )


def allocated_shipping_cost(t: Tables, p: P.MarginParams = P.MarginParams()) -> DataFrame:
    """The group's shipping cost times the line's cost fraction (0 for
    negative product ids)."""
    cm = contribution_margin(t, p)
    share = F.when(F.col("product_id") < 0, F.lit(0.0)).otherwise(
        F.col("shipping_cost_per_shipping_method").cast("double") * F.col("cost_fraction"))
    return cm.select("order_id", "product_id", "website_id", "shipping_method", "line_total_ex_vat",
                     share.alias("ALLOCATED_SHIPPING_COST"))
