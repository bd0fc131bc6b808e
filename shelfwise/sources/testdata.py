"""Logical tables derived from the driver's TPC-H-like test tables.

Every logical table is a Spark plan over ``lineitem``, ``orders``, ``part`` and
``supplier``, so its size grows with the scale factor. The same derivation is
written as DuckDB SQL in ``oracles.adapter`` for the oracle checks; the two must be
kept in step (FIXTURES.md §2 documents the mapping).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..conf import split_shuffles
from ..functions.exprs import floor_nonpositive
from ..operators.relational import class_wide, merged, not_in_by_key
from ..params import D42_IN_STOCK, TESTDATA_AS_OF, YEAR_IN_STOCK
from .tables import Tables, conform

# Fixture choices (ours, not business constants): value lists picked by a modulo.
WEBSITES_BY_CUSTOMER = (3, 4, 6, 7, 8, 14, 15, 99)
CHANNELS_BY_ORDER = ("GCNL", "FXBE", "FXES", "FXFR", "FXDE", "BOL", "ManoMano", "Showroom",
                     "Amazon", "VWW", "Other")
METHODS_BY_ORDER = ("pallet", "pallet_manual", "flatrate_flatrate", "standard", None)
MAKERS_BY_BRAND = ("Festool", "Makita", "DeWALT", "Bosch")   # brand number % 5; 4 keeps p_brand
PART_TYPES = ("ECONOMY", "SMALL", "MEDIUM", "PROMO", "STANDARD", "LARGE")
CATEGORY_BY_TYPE = {"PROMO": "Bladblazers accu", "SMALL": "Bureaulamp", "LARGE": "LED Lamp"}
SUPPLIER_NAMES = {1: "Makita Nederland", 2: "Transferro B.V.", 3: "Transferro B.V. - Bosch",
                  4: "EOL / Discontinued"}
CLASS_PERIODS = (("week", 7), ("42_days", 42), ("year", 365))
CLASS_THRESHOLDS = ((200, "A+"), (150, "A"), (100, "B"), (50, "C"))
HISTORY_DAYS = 100
ROWS_PER_TASK = 2_000_000    # of the generated history
SUPPLIER_ROOM = 10_000_000   # above every supplier key
BROADCAST_ROWS = 200_000     # of a table that the order lines look up


def pick(index: Column, values) -> Column:
    """values[index] as a CASE chain (NULL entries stay NULL)."""
    expr = None
    for i, value in enumerate(values):
        if value is None:
            continue
        expr = (F.when(index == i, F.lit(value)) if expr is None
                else expr.when(index == i, F.lit(value)))
    return expr


def _brand_number() -> Column:
    return F.substring(F.col("p_brand"), 7, 10).cast("int")


def _maker() -> Column:
    return F.coalesce(pick(_brand_number() % 5, MAKERS_BY_BRAND), F.col("p_brand"))


def _category() -> Column:
    expr = F.when(F.col("p_type") == "PROMO", CATEGORY_BY_TYPE["PROMO"])
    for key in ("SMALL", "LARGE"):
        expr = expr.when(F.col("p_type") == key, CATEGORY_BY_TYPE[key])
    return expr.otherwise(F.col("p_type"))


def _main_category_id() -> Column:
    idx = F.lit(7)
    for i, name in reversed(list(enumerate(PART_TYPES, start=1))):
        idx = F.when(F.col("p_type") == name, F.lit(i)).otherwise(idx)
    return (idx * 10 + F.col("p_size") % 4 + 1).cast("long")


def _dec(c: Column, p: int, s: int) -> Column:
    return c.cast(f"decimal({p},{s})")


def _times(c: Column, factor: str) -> Column:
    """c * factor in DECIMAL, rounded half up to 4 places."""
    digits = len(factor.split(".")[1])
    return _dec(c * F.lit(factor).cast(f"decimal({len(factor) - 1},{digits})"), 18, 4)


def looked_up(table: DataFrame) -> DataFrame:
    """``table`` as a side of the order lines' joins. A job that needs little more than its
    keys would broadcast millions of rows, which the driver builds in four times their size."""
    return merged(table) if table.count() > BROADCAST_ROWS else table


def order_lines(lineitem: DataFrame, orders: DataFrame, part: DataFrame) -> DataFrame:
    joined = (lineitem.join(looked_up(orders), lineitem.l_orderkey == orders.o_orderkey)
              .join(looked_up(part), lineitem.l_partkey == part.p_partkey))
    key = F.col("l_orderkey") + F.col("l_linenumber")
    ex_vat = _dec(_dec(F.col("l_extendedprice"), 12, 2) * (F.lit(1) - _dec(F.col("l_discount"), 4, 2))
                  * F.lit("0.005").cast("decimal(3,3)"), 18, 4)
    qty = F.col("l_quantity").cast("long")
    status = (F.when(F.col("o_orderstatus") == "F", 5)
              .when(F.col("o_orderstatus") == "O", 2).otherwise(0))
    order_type = (F.when(F.col("o_orderkey") % 13 == 0, "follow_up_shipment")
                  .when(F.col("o_orderkey") % 13 == 1, "rma").otherwise("sales_order"))
    # a quarter of the orders ships its later lines by another method
    second_method = F.when((F.col("o_orderkey") % 4 == 0) & (F.col("l_linenumber") >= 5), 1).otherwise(0)
    df = joined.select(
        (F.col("l_orderkey") + 1).alias("order_id"),
        F.col("o_orderdate").alias("order_date"),
        F.when(key % 97 == 0, F.lit(-4)).when(key % 101 == 0, F.lit(-11))
         .otherwise(F.col("l_partkey") + 1).alias("product_id"),
        F.col("p_name").alias("description"),
        _maker().alias("brand"),
        _category().alias("category"),
        F.concat(F.lit("ROOT_"), (F.col("p_size") % 4).cast("string")).alias("root_category"),
        _times(ex_vat, "1.21").alias("line_total"),
        ex_vat.alias("line_total_ex_vat"),
        _times(ex_vat, "0.25").alias("margin_total_net"),
        _times(ex_vat, "0.70").alias("purchase_net"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), -qty)
         .otherwise(qty).alias("qty"),
        pick(F.col("o_custkey") % 8, WEBSITES_BY_CUSTOMER).alias("website_id"),
        pick(F.col("o_orderkey") % 11, CHANNELS_BY_ORDER).alias("channel"),
        pick((F.col("o_orderkey") + second_method) % 5, METHODS_BY_ORDER).alias("shipping_method"),
        status.alias("status"),
        order_type.alias("order_type"),
        F.when(F.col("l_partkey") % 10 == 0, "COMPOSITION").otherwise("SIMPLE").alias("line_type"),
        F.year(F.col("o_orderdate")).alias("year_number"),
        F.date_format(F.col("o_orderdate"), "EEEE").alias("day_name"),
        (F.col("l_linenumber") - 1).alias("shipped_in"),
    )
    return conform(df, "order_lines")


def _cost(factor: str) -> Column:
    return _times(_dec(F.col("p_retailprice"), 12, 2), factor)


def first_suppliers(lineitem: DataFrame) -> DataFrame:
    """The supplier of each part's first line (parts without lines have none)."""
    first = F.min(F.col("l_orderkey") * SUPPLIER_ROOM + F.col("l_suppkey")) % SUPPLIER_ROOM
    return lineitem.groupBy(F.col("l_partkey").alias("_pk")).agg(first.alias("_supplier"))


def products(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    """A supplier of its lines for most parts; none for some, one that the supplier table
    lacks for others."""
    k = F.col("p_partkey")
    suppliers_of = first_suppliers(lineitem)
    df = part.join(suppliers_of, part.p_partkey == suppliers_of._pk, "left").select(
        (k + 1).alias("product_id"),
        F.col("p_name").alias("name_nl"),
        F.concat(F.lit("871"), F.lpad(k.cast("string"), 10, "0")).alias("ean"),
        F.when(k % 17 == 0, "hidden").when(k % 19 == 0, F.lit(None)).otherwise("visible").alias("status"),
        _cost("0.60").alias("cost"),
        _cost("0.55").alias("cost_net"),
        F.when(k % 53 == 0, F.lit(None)).otherwise(F.col("p_size") - 10).alias("stock_magento"),
        F.col("p_size").alias("stock_hbs"),
        _brand_number().alias("manufacturer_id"),
        F.when(k % 29 == 0, F.lit(None)).when(k % 31 == 0, F.col("_supplier") + SUPPLIER_ROOM)
         .otherwise(F.col("_supplier")).alias("default_supplier_id"),
        _main_category_id().alias("main_category_id"),
    )
    return conform(df, "products")


def manufacturers(part: DataFrame) -> DataFrame:
    df = part.select(_brand_number().alias("manufacturer_id"), _maker().alias("name")).distinct()
    return conform(df, "manufacturers")


def categories(part: DataFrame) -> DataFrame:
    """Main categories (type x size % 4) with their root, plus the four roots."""
    root = F.col("p_size") % 4
    main = part.select(
        _main_category_id().alias("category_id"),
        (root + 100).alias("root_category_id"),
        _category().alias("name_nl"),
    ).distinct()
    roots = part.select(
        (root + 100).alias("category_id"),
        F.lit(None).cast("long").alias("root_category_id"),
        F.concat(F.lit("ROOT_"), root.cast("string")).alias("name_nl"),
    ).distinct()
    return conform(main.unionByName(roots), "categories")


def suppliers(supplier: DataFrame) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.coalesce(pick(k % 20, [SUPPLIER_NAMES.get(i) for i in range(20)]), F.col("s_name"))
    df = supplier.select(
        k.alias("supplier_id"), name.alias("name"),
        F.when(k % 3 == 0, "OEM").when(k % 3 == 1, "trader").alias("type"),
    )
    return conform(df, "suppliers")


def set_items(part: DataFrame) -> DataFrame:
    parents = part.where(F.col("p_partkey") % 10 == 0)
    df = parents.select(
        (F.col("p_partkey") + 1).alias("parent_product_id"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("k"),
        F.col("p_size"),
    ).select(
        "parent_product_id",
        (F.col("parent_product_id") + F.col("k")).alias("child_product_id"),
        (F.lit(1) + (F.col("p_size") + F.col("k") - 1) % 3).alias("quantity"),
    )
    return conform(df, "set_items")


def _product_list(part: DataFrame, modulus: int, name: str, **extra) -> DataFrame:
    pid = F.col("p_partkey") + 1
    cols = [pid.alias("product_id")] + [F.lit(v).alias(k) for k, v in extra.items()]
    return conform(part.where(pid % modulus == 0).select(*cols), name)


def product_labels(part: DataFrame) -> DataFrame:
    pid = F.col("p_partkey") + 1
    new = part.where(pid % 23 == 0).select(pid.alias("product_id"), F.lit("new").alias("label"))
    promo = part.where(pid % 69 == 0).select(pid.alias("product_id"), F.lit("promo").alias("label"))
    return conform(new.unionByName(promo), "product_labels")


def channel_commission(part: DataFrame) -> DataFrame:
    pid = F.col("p_partkey") + 1
    rate = ((pid % 7 + 5).cast("double") / 100).cast("decimal(9,4)")
    return conform(part.where(pid % 3 != 0).select(pid.alias("product_id"),
                                                   rate.alias("commission_percentage")),
                   "channel_commission")


def classifications(lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Per (product, period, type): sales sum, daily mean and A+..D label.

    One scan of the last year of lines with conditional sums per period; the six
    (period, type) rows per product come from one ``explode`` of an array of structs.
    """
    day = F.to_date(F.col("order_date"))
    year_from = as_of - dt.timedelta(days=365)
    recent = lines.where((F.col("order_date") >= F.lit(year_from + dt.timedelta(days=1)))
                         & (F.col("product_id") > 0) & (day <= F.lit(as_of)))
    aggs = []
    for period, days in CLASS_PERIODS:
        inside = day > F.lit(as_of - dt.timedelta(days=days))
        aggs.append(F.sum(F.when(inside, F.col("qty"))).alias(f"s_{period}"))
        aggs.append(F.count(F.when(inside, F.lit(1))).alias(f"n_{period}"))
    sums = recent.groupBy("product_id").agg(*aggs)
    rows = []
    for period, days in CLASS_PERIODS:
        for ctype in ("sales", "sales_in_stock"):
            rows.append((period, days, ctype))
    stacked = sums.select(
        "product_id",
        F.explode(F.array(*[
            F.struct(F.lit(period).alias("period"), F.lit(ctype).alias("type"),
                     F.lit(days).alias("days"), F.col(f"s_{period}").alias("s"),
                     F.col(f"n_{period}").alias("n"))
            for period, days, ctype in rows
        ])).alias("r"),
    ).select("product_id", "r.*").where(F.col("n") > 0)
    mean = F.col("s").cast("double") / F.col("days")
    in_stock_mean = F.when(F.col("product_id") % 7 == 0, F.lit(0.0)).otherwise(mean * 1.25)
    label = F.lit("D")
    for bound, name in reversed(CLASS_THRESHOLDS):
        label = F.when(F.col("s") >= bound, name).otherwise(label)
    df = stacked.select(
        "product_id", "period", "type", label.alias("label"),
        F.when(F.col("type") == "sales", mean).otherwise(in_stock_mean).alias("mean"),
        F.col("s").alias("absolute"),
    )
    return conform(df, "classifications")


def pending_po(lineitem: DataFrame) -> DataFrame:
    status = (F.lit(2) + F.col("l_linenumber") % 4)
    qty = F.col("l_quantity").cast("long") % 4   # small, so that reports find something left to order; some are 0
    df = lineitem.where(F.col("l_linestatus") == "O").select(
        (F.col("l_partkey") + 1).alias("product_id"),
        F.when((F.col("l_returnflag") == "R") & (status == 5), -qty).otherwise(qty).alias("qty"),
        status.alias("status_id"),
        F.when(F.col("l_orderkey") % 9 == 0, F.col("l_shipdate")).alias("deleted_at"),
    )
    return conform(df, "pending_po")


def product_history(part: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per product and day over the last 100 days.

    A join with the days, not an ``explode``: Spark's size estimate of an exploded table is
    that of its input, so that the whole history could pass for a side to broadcast. The
    parts come in few, small file splits and every row becomes HISTORY_DAYS + 1; they are
    dealt out first, so that a task makes about ROWS_PER_TASK rows whatever the size.
    """
    start = as_of - dt.timedelta(days=HISTORY_DAYS)
    k = F.col("p_partkey")
    tasks = -(-part.count() * (HISTORY_DAYS + 1) // ROWS_PER_TASK)
    parts = part.select(k, "p_size", "p_retailprice").repartition(max(1, tasks))
    day_idx = part.sparkSession.range(HISTORY_DAYS + 1).select(F.col("id").cast("int").alias("day_idx"))
    df = parts.crossJoin(F.broadcast(day_idx)).select(
        (k + 1).alias("product_id"),
        F.date_add(F.lit(start), F.col("day_idx")).alias("date"),
        _cost("0.55").alias("cost_net"),
        F.when(k % 53 == 0, F.lit(None))
         .otherwise(F.col("p_size") - 10 + (k + F.col("day_idx")) % 15 - 7).alias("stock_magento"),
    )
    return conform(df, "product_history")


def stock_health_snapshots(history: DataFrame, classes: DataFrame, bundles: DataFrame) -> DataFrame:
    """One stock-health snapshot row per stocked non-parent product and history day, with
    the current in-stock means (the given tables hold no older ones)."""
    # one shuffle of the history by product serves the parent test and the means
    hist = not_in_by_key(history.where(F.col("stock_magento") > 0), "product_id", bundles, "parent_product_id")
    means = class_wide(classes, [(YEAR_IN_STOCK, "mean", "_m365"), (D42_IN_STOCK, "mean", "_m42")])
    means = means.withColumnRenamed("product_id", "_mpid")
    m42 = F.col("_m42")
    df = hist.join(means, hist.product_id == means._mpid, "left").select(
        "product_id", F.col("date").alias("snapshot_date"), "stock_magento",
        F.round(F.col("cost_net") * F.col("stock_magento"), 2).alias("STOCK_VALUE"),
        floor_nonpositive(m42).alias("AVG_SALES_IN_STOCK_42_DAYS"),
        floor_nonpositive(F.col("_m365")).alias("AVG_SALES_IN_STOCK_365_DAYS"),
        F.when(m42 <= 0, F.lit(0.0)).otherwise(F.col("stock_magento") / m42).alias("ESTIMATED_STOCK_DAYS"))
    return conform(df, "stock_health_snapshots")


def load(spark: SparkSession, sf_dir: str, as_of: dt.date = TESTDATA_AS_OF) -> Tables:
    """All logical tables over the test tables in ``sf_dir``."""
    def read(name):
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    part = lambda: read("part")
    split_shuffles(spark, part().count() * (HISTORY_DAYS + 1))   # the history is the largest table
    builders = {
        "order_lines": lambda: order_lines(read("lineitem"), read("orders"), part()),
        "products": lambda: products(part(), read("lineitem")),
        "manufacturers": lambda: manufacturers(part()),
        "categories": lambda: categories(part()),
        "suppliers": lambda: suppliers(read("supplier")),
        "set_items": lambda: set_items(part()),
        "product_labels": lambda: product_labels(part()),
        "channel_commission": lambda: channel_commission(part()),
        "clearance_products": lambda: _product_list(part(), 29, "clearance_products"),
        "clearance_products_hist": lambda: _product_list(part(), 31, "clearance_products_hist"),
        "auto_disable_products": lambda: _product_list(part(), 37, "auto_disable_products"),
        "bf_assortment_sales": lambda: _product_list(part(), 47, "bf_assortment_sales"),
        "separate_parcel_products": lambda: _product_list(part(), 5, "separate_parcel_products"),
        "min_order_qty": lambda: _product_list(part(), 41, "min_order_qty", minimum_qty=2.5),
        "min_desired_qty": lambda: _product_list(part(), 43, "min_desired_qty", minimum_desired_qty=4),
        "pending_po": lambda: pending_po(read("lineitem")),
        "product_history": lambda: product_history(part(), as_of),
    }
    builders["stock_health_snapshots"] = lambda: stock_health_snapshots(
        tables.product_history, tables.classifications, tables.set_items)
    builders["classifications"] = lambda: classifications(tables.order_lines, as_of)
    tables = Tables(builders)
    return tables
