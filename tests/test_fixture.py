"""What the fixture holds, so that parity with the oracles proves something (DuckDB only)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as E
from oracles.adapter import adapter_ctes

SF = {s: f"/root/testdata/sf{s}" for s in ("0.01", "0.1")}


@pytest.fixture(scope="module")
def count():
    if not all(os.path.isdir(d) for d in SF.values()):
        pytest.skip("test tables missing")
    cons = {}
    for s, path in SF.items():
        cons[s] = duckdb.connect()
        for t in ("lineitem", "orders", "part", "supplier"):
            cons[s].execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    sql = E.oracle_sql()
    return lambda key, what="count(*)", sf="0.01": cons[sf].sql(
        f"SELECT {what} FROM ({sql.get(key) or key}) AS q").fetchall()[0][0]


def table(name):
    ctes = adapter_ctes(E.PR.as_of)
    return "WITH " + ", ".join(f"{n} AS ({b})" for n, b in ctes.items()) + f" SELECT * FROM {name}"


def test_orders_have_several_shipping_groups(count):
    """The rollup is joined back on the order alone, so their lines fan out."""
    assert count("b1_order_rollup") > count("b1_order_rollup", "count(DISTINCT order_id)")
    assert count("b1_contribution_margin") > count("b1_eligible_lines")


def test_final_filters_leave_rows_and_meet_what_they_drop(count):
    for key in ("b5_expected_sales_leaf_blowers_orderable", "b6_expected_sales_lamps_orderable",
                "b7_expected_sales_horizon"):
        assert count(key) >= 100
    for key in ("b5_expected_sales_leaf_blowers", "b6_expected_sales_lamps"):
        assert count(key, "count(*) FILTER (DEFAULT_SUPPLIER IS NULL)") > 0
        assert count(key, "count(*) FILTER (ORDER_QTY = 0)") > 0
    assert count("b7_horizon_candidates", "count(*) FILTER (DEFAULT_SUPPLIER IS NULL)") > 0
    assert count(table("pending_po"), "count(*) FILTER (qty = 0)") > 0


def test_suppliers_grow_with_the_rows(count):
    assert count("b9_purchase_value") > 230
    assert count("b9_purchase_value", sf="0.1") > 464
    keys = [count(table("products"), "count(DISTINCT default_supplier_id)", sf) for sf in SF]
    assert keys[1] > 5 * keys[0]
