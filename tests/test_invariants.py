"""Invariants of the jobs on the driver's sf0.001 tables."""

from __future__ import annotations

from collections import defaultdict

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from shelfwise.params import TESTDATA_PROFILE as PR
from shelfwise.plans import bundles, expected_sales, margin, replenishment, stock_health
from shelfwise.sources import testdata

OVERLAPS = ((30, 31), (90, 91), (180, 181), (365, 366))


@pytest.fixture(scope="module")
def t(spark):
    return testdata.load(spark, SF_SMALL, PR.as_of)


def test_cost_fractions_sum_to_one(t):
    """Per order with one (website, method) group, no product 0 and no negative or NULL
    ex-VAT line, the fractions of the positive lines add up to 1."""
    rows = margin.contribution_margin(t, PR.margin).collect()
    orders = defaultdict(list)
    for r in rows:
        orders[r.order_id].append(r)
    checked = 0
    for lines in orders.values():
        groups = {(r.website_id, r.shipping_method) for r in lines}
        if len(groups) != 1 or any(r.product_id == 0 or r.line_total_ex_vat is None
                                   or r.line_total_ex_vat < 0 for r in lines):
            continue
        total = sum(r.cost_fraction for r in lines if r.product_id > 0)
        assert abs(total - 1.0) < 1e-9
        checked += 1
    assert checked > 100


def test_order_quantities_are_never_negative(t):
    for df, col in ((replenishment.replenishment_list(t, PR.replenishment, sort=False), "ORDER_QTY"),
                    (expected_sales.seasonal_expected_sales(t, PR.leaf_blower, sort=False), "ORDER_QTY"),
                    (expected_sales.seasonal_expected_sales(t, PR.lamps, sort=False), "ORDER_QTY"),
                    (expected_sales.horizon_expected_sales(t, PR.horizon, sort=False), "ORDER_QTY")):
        assert df.where(F.col(col) < 0).count() == 0


def test_buckets_add_up_to_the_stock_value(t):
    rows = stock_health.stock_health(t, PR.stock_health, sort=False).collect()
    checked = 0
    for r in rows:
        v, days = r.STOCK_VALUE, r.ESTIMATED_STOCK_DAYS
        if not v or v <= 0 or not r.AVG_SALES_IN_STOCK_42_DAYS or r.AVG_SALES_IN_STOCK_42_DAYS <= 0:
            continue
        if any(lo < days < hi for lo, hi in OVERLAPS):
            continue
        spread = (r.SUM_OF_0_30_DGN + r.SUM_OF_31_90_DGN + r.SUM_OF_91_180_DGN + r.SUM_OF_180_365_DGN
                  + r.MORE_THAN_365_DGN)
        assert abs(spread - float(v)) < 1e-6 * max(1.0, float(v))
        checked += 1
    assert checked > 10


def test_child_quantities_are_conserved(t):
    """Σ quantity_sold = Σ qty of direct lines + Σ qty x bridge quantity of bundle lines."""
    p = PR.shipped_child
    out = bundles.shipped_child_quantities(t, p, sort=False).agg(F.sum("quantity_sold")).first()[0]
    lines = t.order_lines.where((F.col("status") == p.status) & (F.col("year_number") == p.year)
                                & (F.col("order_type") == p.order_type) & F.col("website_id").isin(*p.websites)
                                & (F.col("product_id") > 0))
    parents = t.set_items.select(F.col("parent_product_id").alias("pp")).distinct()
    direct = lines.join(parents, lines.product_id == parents.pp, "left_anti").agg(F.sum("qty")).first()[0]
    bridge = t.set_items.select(F.col("parent_product_id").alias("pp"), "quantity")
    bundled = (lines.where(F.col("line_type") == p.composition_line_type)
               .join(bridge, F.col("product_id") == F.col("pp"))
               .agg(F.sum(F.col("qty") * F.col("quantity"))).first()[0])
    assert out == direct + bundled
