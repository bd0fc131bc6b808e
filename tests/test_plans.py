"""Plan shape: what the physical plans must and must not contain (via ``explain``)."""

from __future__ import annotations

import re

import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from shelfwise.params import TESTDATA_PROFILE as PR
from shelfwise.plans import bundles, history, margin, purchase, replenishment, stock_health
from shelfwise.sources import testdata
from shelfwise.sources.tables import from_warehouse, write_warehouse

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "ArrowEvalPython",
             "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas")


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture(scope="module")
def warehouse(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("warehouse"))
    write_warehouse(testdata.load(spark, SF_SMALL, PR.as_of), root)
    return from_warehouse(spark, root)


@pytest.mark.parametrize("key", sorted(E.JOBS))
def test_no_nested_loop_cartesian_or_python(spark, capsys, warehouse, key):
    plan = plan_of(E.run(key, warehouse, PR), capsys)
    for node in FORBIDDEN:
        assert node not in plan, f"{key}: {node}"


def scans(plan: str, table: str) -> list[str]:
    """The formatted Scan blocks reading ``table``."""
    blocks = re.split(r"\n\(\d+\) ", plan)
    return [b for b in blocks if b.startswith("Scan parquet") and f"/{table}]" in b]


def test_history_partitions_are_pruned(spark, capsys, warehouse):
    for df in (history.out_of_stock_base(warehouse, PR.out_of_stock),
               replenishment.reorder_factors(warehouse, PR.replenishment)):
        blocks = scans(plan_of(df, capsys), "product_history")
        assert blocks and all(re.search(r"PartitionFilters: \[.*date.*>=?", b) for b in blocks), blocks


def test_date_and_equality_filters_reach_the_scan(spark, capsys, warehouse):
    blocks = scans(plan_of(margin.contribution_margin(warehouse, PR.margin), capsys), "order_lines")
    assert blocks and all("GreaterThanOrEqual(order_date,1999-01-01" in b for b in blocks)
    assert all("EqualTo(order_type,sales_order)" in b for b in blocks)
    blocks = scans(plan_of(bundles.shipped_child_quantities(warehouse, PR.shipped_child), capsys), "order_lines")
    assert blocks and all("EqualTo(year_number,2000)" in b for b in blocks)


def test_columns_are_pruned(spark, capsys, warehouse):
    blocks = scans(plan_of(purchase.purchase_value(warehouse, PR.purchase_value), capsys), "order_lines")
    schema = re.search(r"ReadSchema: struct<([^>]*)>", blocks[0]).group(1)
    read = set(re.findall(r"(\w+):", schema))
    assert read == {"order_date", "product_id", "category", "purchase_net", "website_id", "status"}


def test_null_guard_is_not_copied_into_joined_tables(spark, capsys, warehouse):
    """The NOT IN guard names no column, so constraint inference cannot spread it."""
    plan = plan_of(history.out_of_stock_base(warehouse, PR.out_of_stock), capsys)
    hosted = re.findall(r"Hosting Expression = Subquery (subquery#\d+)", plan)
    # parents, auto-disabled and clearance are tested as one NOT IN: its scalar is used by
    # the row filter and by the sentinel row, in the two uses of the product side
    assert len(set(hosted)) <= 2
    assert len(hosted) <= 8


def test_margin_pre_aggregates_before_the_order_shuffle(spark, capsys, warehouse):
    plan = plan_of(margin.contribution_margin(warehouse, PR.margin), capsys)
    assert re.search(r"Keys \[3\]: \[order_id#\d+L, website_id#\d+, shipping_method#\d+\]\n"
                     r"Functions \[3\]: \[partial_sum", plan)


def test_margin_reads_the_lookups_once_and_rolls_up_narrow_lines(spark, capsys, warehouse):
    """One plan of the product lookups (the second use is a reused exchange); the rollup's
    scan of the lines reads the order columns and what the filters need."""
    df = margin.contribution_margin(warehouse, PR.margin)
    df.collect()  # AQE reuses an exchange when it meets the same stage again
    final = plan_of(df, capsys).split("== Initial Plan ==")[0]
    assert "ReusedExchange" in final, final
    plan = plan_of(margin.contribution_margin(warehouse, PR.margin), capsys)
    assert plan.count("SortMergeJoin FullOuter") == 0
    reads = [set(re.findall(r"(\w+):", re.search(r"ReadSchema: struct<([^\n]*)>", b).group(1)))
             for b in scans(plan, "order_lines")]
    filters = {"order_date", "order_type", "status", "qty", "channel"}
    assert {"order_id", "website_id", "shipping_method", "product_id", "line_total_ex_vat"} | filters in reads


def test_bundles_scan_the_lines_once(spark, capsys, warehouse):
    for df in (bundles.shipped_child_quantities(warehouse, PR.shipped_child),
               bundles.bundle_child_quantities(warehouse, PR.shipped_child)):
        assert len(scans(plan_of(df, capsys), "order_lines")) == 1


def test_parents_are_excluded_once_per_product(spark, capsys, warehouse):
    """The null-aware anti join reads the distinct products of the history."""
    df = history.stock_development(warehouse)
    capsys.readouterr()
    df.explain("extended")
    text = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    lines = text.splitlines()
    anti = [i for i, x in enumerate(lines) if "Join LeftAnti" in x]
    assert anti
    for i in anti:
        below = [x for x in lines[i + 1:] if re.search(r"Aggregate \[\w+#\d+L\]|Relation", x)]
        assert re.search(r"Aggregate \[product_id#\d+L\], \[product_id#\d+L AS _nik_key", below[0]) or \
            "_nin_key" in below[0] or "parent_product_id" in below[0], text
    assert "AS _nik_key" in text


SORTED = {
    "b2_replenishment_list": "ORDER_QTY", "b3_stock_health": "STOCK_VALUE",
    "b5_expected_sales_leaf_blowers": "ORDER_VALUE", "b6_expected_sales_lamps": "ORDER_VALUE",
    "b7_expected_sales_horizon": "ORDER_VALUE", "b8_shipped_child_quantities": "quantity_sold",
    "b14_stock_development": "STOCK_VALUE", "d10_low_stock_report": "LOW_STOCK_PERCENTAGE_DAYS",
}


@pytest.mark.parametrize("key", sorted(SORTED))
def test_reports_come_out_in_report_order(spark, warehouse, key):
    """Descending by the report's sort column, NULLs last (the oracle compare ignores order)."""
    values = [r[SORTED[key]] for r in E.run(key, warehouse, PR).collect()]
    present = [v for v in values if v is not None]
    assert values[:len(present)] == present, "NULLs must come last"
    assert all(a >= b for a, b in zip(present, present[1:]))


def test_bucket_totals_plan_the_base_once(spark, capsys, warehouse):
    plan = plan_of(stock_health.bucket_totals(warehouse, PR.stock_health), capsys)
    once = plan_of(stock_health.stock_health_base(warehouse), capsys)
    assert len(scans(plan, "product_labels")) == len(scans(once, "product_labels")) == 1
