"""Schemas of the logical input tables (the columns the jobs read).

Money is DECIMAL so sums are exact and rounding is half away from zero on every
engine; rates and means are DOUBLE.
"""

from pyspark.sql.types import (
    DateType, DecimalType, DoubleType, IntegerType, LongType, StringType,
    StructField, StructType, TimestampNTZType,
)

MONEY = DecimalType(18, 4)


def _schema(*fields):
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


ORDER_LINES = _schema(
    ("order_id", LongType()), ("order_date", TimestampNTZType()), ("product_id", LongType()),
    ("description", StringType()), ("brand", StringType()), ("category", StringType()),
    ("root_category", StringType()), ("line_total", MONEY), ("line_total_ex_vat", MONEY),
    ("margin_total_net", MONEY), ("purchase_net", MONEY), ("qty", LongType()),
    ("website_id", IntegerType()), ("channel", StringType()), ("shipping_method", StringType()),
    ("status", IntegerType()), ("order_type", StringType()), ("line_type", StringType()),
    ("year_number", IntegerType()), ("day_name", StringType()), ("shipped_in", IntegerType()),
)

PRODUCTS = _schema(
    ("product_id", LongType()), ("name_nl", StringType()), ("ean", StringType()),
    ("status", StringType()), ("cost", MONEY), ("cost_net", MONEY),
    ("stock_magento", LongType()), ("stock_hbs", LongType()), ("manufacturer_id", LongType()),
    ("default_supplier_id", LongType()), ("main_category_id", LongType()),
)

PRODUCT_HISTORY = _schema(
    ("product_id", LongType()), ("date", DateType()), ("cost_net", MONEY), ("stock_magento", LongType()),
)

STOCK_HEALTH_SNAPSHOTS = _schema(
    ("PRODUCT_ID", LongType()), ("snapshot_date", DateType()), ("STOCK_MAGENTO", LongType()),
    ("STOCK_VALUE", DecimalType(18, 2)), ("AVG_SALES_IN_STOCK_42_DAYS", DoubleType()),
    ("AVG_SALES_IN_STOCK_365_DAYS", DoubleType()), ("ESTIMATED_STOCK_DAYS", DoubleType()),
)

CLASSIFICATIONS = _schema(
    ("product_id", LongType()), ("period", StringType()), ("type", StringType()),
    ("label", StringType()), ("mean", DoubleType()), ("absolute", LongType()),
)

PRODUCT_LABELS = _schema(("product_id", LongType()), ("label", StringType()))
SET_ITEMS = _schema(("parent_product_id", LongType()), ("child_product_id", LongType()), ("quantity", LongType()))
MANUFACTURERS = _schema(("manufacturer_id", LongType()), ("name", StringType()))
SUPPLIERS = _schema(("supplier_id", LongType()), ("name", StringType()), ("type", StringType()))
CATEGORIES = _schema(("category_id", LongType()), ("root_category_id", LongType()), ("name_nl", StringType()))
PENDING_PO = _schema(
    ("product_id", LongType()), ("qty", LongType()), ("status_id", IntegerType()),
    ("deleted_at", TimestampNTZType()),
)
CHANNEL_COMMISSION = _schema(("product_id", LongType()), ("commission_percentage", DecimalType(9, 4)))
PRODUCT_LIST = _schema(("product_id", LongType()))
MIN_ORDER_QTY = _schema(("product_id", LongType()), ("minimum_qty", DoubleType()))
MIN_DESIRED_QTY = _schema(("product_id", LongType()), ("minimum_desired_qty", LongType()))

# Logical table name -> schema. The product lists share one schema.
TABLES = {
    "order_lines": ORDER_LINES,
    "products": PRODUCTS,
    "product_history": PRODUCT_HISTORY,
    "stock_health_snapshots": STOCK_HEALTH_SNAPSHOTS,
    "classifications": CLASSIFICATIONS,
    "product_labels": PRODUCT_LABELS,
    "set_items": SET_ITEMS,
    "manufacturers": MANUFACTURERS,
    "suppliers": SUPPLIERS,
    "categories": CATEGORIES,
    "pending_po": PENDING_PO,
    "channel_commission": CHANNEL_COMMISSION,
    "clearance_products": PRODUCT_LIST,
    "clearance_products_hist": PRODUCT_LIST,
    "auto_disable_products": PRODUCT_LIST,
    "bf_assortment_sales": PRODUCT_LIST,
    "separate_parcel_products": PRODUCT_LIST,
    "min_order_qty": MIN_ORDER_QTY,
    "min_desired_qty": MIN_DESIRED_QTY,
}
