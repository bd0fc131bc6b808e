"""Key checks for the logical tables.

The classification pivot (one row per product instead of one join per slice) is exact
only when (product_id, period, type) is unique; the other keys below are the ones the
jobs expect. ``key_violations`` lists every key value that occurs more than once, per
table, as one distributed aggregation per table (partial counts before the shuffle);
it returns a DataFrame, so a pipeline can write it, count it or fail on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Tables

# table -> columns that identify one row
EXPECTED_KEYS = {
    "classifications": ("product_id", "period", "type"),
    "products": ("product_id",),
    "product_history": ("product_id", "date"),
    "manufacturers": ("manufacturer_id",),
    "suppliers": ("supplier_id",),
    "categories": ("category_id",),
    "channel_commission": ("product_id",),
    "min_order_qty": ("product_id",),
    "min_desired_qty": ("product_id",),
}


def key_violations(t: Tables, keys: dict[str, tuple[str, ...]] = EXPECTED_KEYS) -> DataFrame:
    """Rows (table, key, rows) for every key value held by more than one row."""
    parts = []
    for table, cols in keys.items():
        counted = getattr(t, table).groupBy(*cols).agg(F.count(F.lit(1)).alias("rows"))
        parts.append(counted.where(F.col("rows") > 1).select(
            F.lit(table).alias("table"),
            F.to_json(F.struct(*[F.col(c) for c in cols])).alias("key"),
            "rows"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
