"""Jobs on hand-made tables: fan-out, cost shares, NULL rules and the report quirks."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

from conftest import line, tables, ts

from shelfwise import params as P
from shelfwise.plans import (
    bundles, expected_sales, history, margin, purchase, replenishment, stock_health,
)

AS_OF = dt.date(2022, 6, 30)
RP = P.ReplenishmentParams(as_of=AS_OF)


def money(x):
    return None if x is None else D(str(x)).quantize(D("0.0001"))


def margin_line(order_id, product_id, ex_vat, method="standard", qty=1, **kw):
    return line(order_id=order_id, product_id=product_id, line_total=money(ex_vat * 1.21),
                line_total_ex_vat=money(ex_vat), margin_total_net=money(ex_vat / 4),
                shipping_method=method, qty=qty, **kw)


def test_margin_keeps_fan_out_of_two_shipping_methods(spark):
    t = tables(spark, order_lines=[margin_line(1, 7, 10.0, "standard"), margin_line(1, 8, 20.0, "standard"),
                                   margin_line(1, 9, 30.0, "pallet")])
    rows = margin.contribution_margin(t).collect()
    assert len(rows) == 6   # each of the 3 lines once per (website, method) group of its order
    per_line = {}
    for r in rows:
        per_line.setdefault(r.product_id, []).append(r.shipping_cost_per_shipping_method)
    assert sorted(per_line[7]) == [D("5.20"), D("41.70")]


def test_cost_fractions_and_dropped_orders(spark):
    t = tables(spark, order_lines=[
        margin_line(1, 7, 60.0), margin_line(1, 8, 40.0), margin_line(1, 9, -5.0),
        margin_line(2, 7, 50.0), margin_line(2, 0, 50.0),
        margin_line(3, -4, 12.0),
    ])
    rows = {(r.order_id, r.product_id): r for r in margin.contribution_margin(t).collect()}
    assert [rows[(1, p)].cost_fraction for p in (7, 8, 9)] == [0.6, 0.4, 0.0]
    assert rows[(2, 7)].cost_fraction == 1.0 and rows[(2, 0)].cost_fraction == 1.0
    assert rows[(2, 0)].total_revenue_for_cost_share == D("50.0000")
    assert not any(k[0] == 3 for k in rows)   # only a negative id: no revenue for the cost share


def test_margin_filters(spark):
    t = tables(spark, order_lines=[
        margin_line(1, 7, 10.0), margin_line(2, -11, 10.0), margin_line(3, 7, 10.0, channel="Other"),
        margin_line(4, 7, 10.0, website_id=99), margin_line(5, 7, 10.0, order_type="rma"),
        margin_line(6, 7, 10.0, qty=0), margin_line(7, 7, 10.0, order_date=ts(2021, 12, 31)),
        margin_line(8, None, 10.0),
    ])
    assert sorted(r.order_id for r in margin.eligible_lines(t).collect()) == [1]


def history_rows(pid, stocks, start=AS_OF):
    return [dict(product_id=pid, date=start - dt.timedelta(days=i), cost_net=D("1.0000"), stock_magento=s)
            for i, s in enumerate(stocks)]


def cls(pid, period, ctype, label="A", mean=1.0, absolute=10):
    return dict(product_id=pid, period=period, type=ctype, label=label, mean=mean, absolute=absolute)


def test_reorder_factor(spark):
    stocks = [100] * 21 + [0] * 5 + [None] + [100]      # 28 days, 6 low (incl. the NULL day)
    hist = history_rows(1, stocks) + history_rows(2, [100] * 28) + history_rows(3, [100] * 40)
    t = tables(spark, product_history=hist, classifications=[
        cls(1, "year", "sales", "A"), cls(1, "42_days", "sales", mean=1.0),
        cls(2, "year", "sales", "B"),                       # no 42-day mean: every day counts as low
        cls(3, "year", "sales", "D"),                       # class D: not in the factor table
    ])
    got = {r.PRODUCT_ID: (r.LOW_STOCK_PERCENTAGE_DAYS, r.REORDER_POINT_FACTOR)
           for r in replenishment.reorder_factors(t, RP).collect()}
    assert got == {1: (21.43, 1.21), 2: (100.0, 2.0)}
    stocks = [0] * 7 + [100] * 21
    t = tables(spark, product_history=history_rows(1, stocks),
               classifications=[cls(1, "year", "sales", "A"), cls(1, "42_days", "sales", mean=1.0)])
    assert [tuple(r)[1:] for r in replenishment.reorder_factors(t, RP).collect()] == [(25.0, 1.25)]


def product(pid, **kw):
    base = dict(product_id=pid, name_nl=f"p{pid}", ean="e", status="visible", cost=D("2.0000"),
                cost_net=D("1.5000"), stock_magento=1, stock_hbs=1, manufacturer_id=1, default_supplier_id=1,
                main_category_id=1)
    base.update(kw)
    return base


def test_replenishment_list_details(spark):
    t = tables(
        spark,
        products=[product(1, stock_magento=-3), product(2), product(3, stock_magento=5)],
        classifications=[cls(1, "year", "sales", "A", mean=2.0), cls(1, "42_days", "sales", mean=2.0),
                         cls(1, "week", "sales", mean=1.0),
                         cls(2, "year", "sales", "B", mean=1.0),
                         cls(3, "year", "sales", "D", mean=1.0)],
        product_labels=[dict(product_id=2, label="new"), dict(product_id=2, label="promo"),
                        dict(product_id=3, label="new"), dict(product_id=3, label="promo")],
        min_order_qty=[dict(product_id=1, minimum_qty=2.5)],
        pending_po=[dict(product_id=1, qty=4, status_id=4, deleted_at=None),
                    dict(product_id=1, qty=-3, status_id=5, deleted_at=None),
                    dict(product_id=2, qty=9, status_id=3, deleted_at=ts(2022, 1, 1))],
        suppliers=[dict(supplier_id=1, name="Other", type=None)],
    )
    rows = replenishment.replenishment_list(t, RP).collect()
    by = {}
    for r in rows:
        by.setdefault(r.PRODUCT_ID, []).append(r)
    p1 = by[1][0]
    assert (p1.MOQ, p1.CONFIRMED, p1.RECEIVED, p1.AVG_SALES_QTY, p1.ORDER_DAYS) == (3, 4, 0, 2.0, 14)
    assert p1.CORRECTED_LEAD_TIME == 14.0 and p1.REORDER_POINT == 28.0
    assert p1.PRIMARY_QTY == 28.0 and p1.ORDER_QTY == 28 + 3 - 4
    assert by[2][0].ORDERED == 0                                  # only soft-deleted rows
    assert sorted(r.LABEL for r in by[2]) == ["new", "promo"]     # one row per label (T15)
    assert {r.ORDER_DAYS for r in by[2]} == {7}
    # class D with stock >= 0 is kept only through its 'new' label row
    assert [(r.LABEL, r.ORDER_DAYS) for r in by[3]] == [("new", 7)]


def set_item(parent, child, quantity=1):
    return dict(parent_product_id=parent, child_product_id=child, quantity=quantity)


def test_bundle_explosion(spark):
    p = P.ShippedChildParams(year=2022)
    lines_ = [line(product_id=10, qty=3, line_type="COMPOSITION", website_id=8),
              line(product_id=11, qty=1, website_id=7)]
    t = tables(spark, order_lines=lines_, set_items=[set_item(10, 11, 2), set_item(10, 12, 1)])
    got = {(r.product_id, r.country): r.quantity_sold for r in bundles.shipped_child_quantities(t, p).collect()}
    assert got == {(11, "FR"): 6, (12, "FR"): 3, (11, "NL"): 1}


def test_null_parent_empties_not_in_jobs(spark):
    """One NULL parent id makes every NOT IN (parents) false (SQL null-aware rule)."""
    items = [set_item(10, 11, 2), set_item(None, 12, 1)]
    lines_ = [line(product_id=10, qty=3, line_type="COMPOSITION", website_id=8, year_number=2021,
                   order_date=ts(2021, 10, 1), category="Bladblazers"),
              line(product_id=11, qty=1, website_id=7, year_number=2021, order_date=ts(2021, 10, 1),
                   category="Bladblazers")]
    t = tables(spark, order_lines=lines_, set_items=items,
               products=[product(11), product(13)], product_history=history_rows(11, [5] * 30),
               classifications=[cls(11, "year", "sales", "A"), cls(11, "42_days", "sales", mean=1.0),
                                cls(11, "year", "sales_in_stock", mean=1.0)],
               manufacturers=[dict(manufacturer_id=1, name="Festool")],
               suppliers=[dict(supplier_id=1, name="Other", type=None)])
    assert replenishment.replenishment_list(t, RP).count() == 0
    assert stock_health.stock_health(t).count() == 0
    assert expected_sales.seasonal_expected_sales(t, P.LEAF_BLOWER_SEASON).count() == 0
    assert expected_sales.horizon_expected_sales(t).count() == 0
    assert purchase.open_purchase_quantities(t).count() == 0
    assert purchase.current_stock(t).count() == 0
    assert history.out_of_stock_base(t, P.OutOfStockParams(as_of=AS_OF)).count() == 0
    assert history.stock_development(t).count() == 0
    got = bundles.shipped_child_quantities(t, P.ShippedChildParams(year=2021)).collect()
    assert [(r.product_id, r.quantity_sold) for r in got] == [(11, 6)]   # bundle lines only
    # without the NULL row the same tables give rows
    t2 = t.replace(set_items=t.set_items.where("parent_product_id IS NOT NULL"))
    assert purchase.current_stock(t2).count() == 2
    assert stock_health.stock_health(t2).count() == 2


def test_out_of_stock_42_day_rule(spark):
    """The 42-day condition accepts a row of either type once a yearly sales row exists."""
    oos = P.OutOfStockParams(as_of=AS_OF)
    hist = history_rows(1, [0, 3]) + history_rows(2, [0, 3]) + history_rows(3, [None])
    t = tables(spark, product_history=hist, products=[product(1), product(2), product(3)],
               suppliers=[dict(supplier_id=1, name="Other", type=None)],
               classifications=[
                   cls(1, "year", "sales", "C"), cls(1, "42_days", "sales", mean=0.01),
                   cls(1, "42_days", "sales_in_stock", mean=0.10),
                   cls(2, "year", "sales_in_stock", "C"), cls(2, "42_days", "sales", mean=0.50),
                   cls(3, "year", "sales", "B"), cls(3, "42_days", "sales", mean=0.05)])
    rows = history.out_of_stock_base(t, oos).collect()
    assert sorted((r.PRODUCT_ID, r.STOCK_MAGENTO) for r in rows) == [(1, 0), (1, 3), (3, 0)]


def test_stock_health_labels_fan_out_and_dedupe(spark):
    t = tables(spark, products=[product(1, stock_magento=10)],
               product_labels=[dict(product_id=1, label="new"), dict(product_id=1, label="promo"),
                               dict(product_id=1, label="promo")],
               classifications=[cls(1, "42_days", "sales_in_stock", mean=0.5),
                                cls(1, "year", "sales_in_stock", mean=0.5)])
    rows = stock_health.stock_health(t).collect()
    assert sorted(r.LABEL for r in rows) == ["new", "promo"]
    assert {r.ESTIMATED_STOCK_DAYS for r in rows} == {20.0}
    assert {r.SUM_OF_0_30_DGN for r in rows} == {15.0}


def test_bucket_totals_of_nothing_is_the_grand_total(spark):
    rows = stock_health.bucket_totals(tables(spark)).collect()
    assert [(r["LEVEL"], r["SALES_CLASS_YEAR"], r["CATEGORY"], r["STOCK_VALUE"]) for r in rows] == [(3, None, None, None)]
