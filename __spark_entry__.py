"""

``entry(spark)`` runs the flagship job (contribution-margin base) on sf0.001.
``queries()`` maps every registered job or sub-job to a callable (spark, sf_dir) ->
DataFrame over the driver's test tables; ``oracle_sql()`` gives the independent DuckDB
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from dataclasses import replace

# The driver may load this file by path; its packages live next to it.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from pyspark.sql.types import DecimalType  # noqa: E402

from oracles.jobs import oracle_queries  # noqa: E402
from shelfwise.conf import apply_conf
from shelfwise.params import TESTDATA_PROFILE as PR
from shelfwise.params import LOW_CASH_SUPPLIERS, Profile
from shelfwise.plans import (
    bundles, expected_sales, history, margin, purchase, replenishment, shipping, stock_health,
)
from shelfwise.sources import testdata

try:  # the training-data operators are optional: the rest works without their folder
    from shelfwise.llm.queries import ORACLE_SQL as LLM_ORACLE_SQL
    from shelfwise.llm.queries import QUERIES as LLM_QUERIES
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith("shelfwise.llm"):
        raise
    LLM_QUERIES, LLM_ORACLE_SQL = {}, {}
try:
    import corpus_pipeline
except ModuleNotFoundError as missing:
    if missing.name != "corpus_pipeline" and not (missing.name or "").startswith("shelfwise.llm"):
        raise
    corpus_pipeline = None

SMOKE_DIR = "/root/testdata/sf0.001"


def _tables(spark: SparkSession, sf_dir: str):
    apply_conf(spark)
    return testdata.load(spark, sf_dir, PR.as_of)


def _report_alternatives(pr: Profile) -> Profile:
    """The replenishment alternatives the report keeps commented out: 42-day rate only,
    Black Friday products out of the class rule, the regular lead time of 28 days."""
    return replace(pr, replenishment_options=dict(rate_rule="42_only", exclude_black_friday=True, lead_days=28))


def _low_cash(pr: Profile) -> Profile:
    """The low-cash emergency the report keeps commented out: 5 days for its own, shorter
    list of fast suppliers."""
    return replace(pr, replenishment_options=dict(fast_lead_suppliers=LOW_CASH_SUPPLIERS,
                                                  fast_supplier_lead_days=5))


def _only_orderable(pr: Profile) -> Profile:
    """The seasonal reports with their commented-out EOL / nothing-to-order filter."""
    return replace(pr, leaf_blower=replace(pr.leaf_blower, only_orderable=True),
                   lamps=replace(pr.lamps, only_orderable=True))


# registry key -> (job over (Tables, Profile), oracle CTE name[, profile variant])
JOBS: dict[str, tuple] = {
    # B1 contribution-margin base and its sub-steps; D8
    "b1_contribution_margin": (lambda t, pr: margin.contribution_margin(t, pr.margin), "b1"),
    "b1_eligible_lines": (lambda t, pr: margin.eligible_lines(t, pr.margin), "b1_lines"),
    "b1_order_rollup": (lambda t, pr: margin.order_rollup(t, pr.margin), "b1_groups"),
    "d8_allocated_shipping_cost": (lambda t, pr: margin.allocated_shipping_cost(t, pr.margin), "d8"),
    # B2 replenishment list and its sub-steps; D9, D10
    "b2_replenishment_list": (lambda t, pr: replenishment.replenishment_list(t, pr.replenishment), "b2"),
    "b2_reorder_factors": (lambda t, pr: replenishment.reorder_factors(t, pr.replenishment), "b2_rpf"),
    "b2_order_counts": (lambda t, pr: replenishment.order_counts(t, pr.replenishment), "b2_oc"),
    "b2_candidates": (lambda t, pr: replenishment.candidates(t, pr.replenishment).distinct(), "b2_candidates"),
    "b2_candidate_open_quantities": (
        lambda t, pr: replenishment.candidate_open_quantities(t, pr.replenishment), "b2_open"),
    "d9_purchase_check": (lambda t, pr: replenishment.purchase_check(t, pr.replenishment), "d9"),
    "d10_low_stock_report": (lambda t, pr: replenishment.low_stock_report(t, pr.replenishment), "d10"),
    "b2_replenishment_list_alternatives": (
        lambda t, pr: replenishment.replenishment_list(t, pr.replenishment), "b2", _report_alternatives),
    "b2_replenishment_list_low_cash": (
        lambda t, pr: replenishment.replenishment_list(t, pr.replenishment), "b2", _low_cash),
    # B3 stock health, B4 trend, D7 bucket totals
    "b3_stock_health": (lambda t, pr: stock_health.stock_health(t, pr.stock_health), "b3"),
    "b3_stock_health_base": (lambda t, pr: stock_health.stock_health_base(t), "b3_base"),
    "b4_stock_health_trend": (lambda t, pr: stock_health.stock_health_trend(
        t.stock_health_snapshots, pr.stock_health), "b4"),
    "b4_stock_health_snapshots": (lambda t, pr: t.stock_health_snapshots, "b4_snapshots"),
    "d7_bucket_totals": (lambda t, pr: stock_health.bucket_totals(t, pr.stock_health), "d7"),
    # B5, B6, B7 expected sales
    "b5_expected_sales_leaf_blowers": (lambda t, pr: expected_sales.seasonal_expected_sales(t, pr.leaf_blower), "b5"),
    "b6_expected_sales_lamps": (lambda t, pr: expected_sales.seasonal_expected_sales(t, pr.lamps), "b6"),
    "b5_expected_sales_leaf_blowers_orderable": (
        lambda t, pr: expected_sales.seasonal_expected_sales(t, pr.leaf_blower), "b5", _only_orderable),
    "b6_expected_sales_lamps_orderable": (
        lambda t, pr: expected_sales.seasonal_expected_sales(t, pr.lamps), "b6", _only_orderable),
    "b5_season_sales": (lambda t, pr: expected_sales.season_sales(t, pr.leaf_blower), "b5_season"),
    "b7_expected_sales_horizon": (lambda t, pr: expected_sales.horizon_expected_sales(t, pr.horizon), "b7"),
    "b7_horizon_candidates": (lambda t, pr: expected_sales.horizon_candidates(t, pr.horizon), "b7_rows"),
    # B8 shipped child quantities
    "b8_shipped_child_quantities": (lambda t, pr: bundles.shipped_child_quantities(t, pr.shipped_child), "b8"),
    "b8_bundle_child_quantities": (
        lambda t, pr: bundles.bundle_child_quantities(t, pr.shipped_child), "b8_bundle_out"),
    # B9, B10, B11 purchase and stock listings; D4, D5
    "b9_purchase_value": (lambda t, pr: purchase.purchase_value(t, pr.purchase_value), "b9"),
    "b10_open_purchase_quantities": (lambda t, pr: purchase.open_purchase_quantities(t), "b10"),
    "b11_current_stock": (lambda t, pr: purchase.current_stock(t), "b11"),
    "d4_open_purchase_values": (lambda t, pr: purchase.open_purchase_values(t), "d4"),
    "d5_stock_value_totals": (lambda t, pr: purchase.stock_value_totals(t), "d5"),
    # B12 out-of-stock base, D3; B14 stock development, D6
    "b12_out_of_stock_base": (lambda t, pr: history.out_of_stock_base(t, pr.out_of_stock), "b12"),
    "b12_followed_products": (
        lambda t, pr: history.eligible_for_out_of_stock(t, pr.out_of_stock).distinct(), "b12_products"),
    "d3_out_of_stock_percentage": (lambda t, pr: history.out_of_stock_percentage(t, pr.out_of_stock), "d3"),
    "b14_stock_development": (lambda t, pr: history.stock_development(t), "b14"),
    "d6_stock_value_per_class": (lambda t, pr: history.stock_value_per_class(t), "d6"),
    # B13 shipping-time base, D1, D2
    "b13_shipping_lines": (lambda t, pr: shipping.shipping_lines(t, pr.shipping_time), "b13"),
    "d1_class_shares": (lambda t, pr: shipping.class_shares(t, pr.shipping_time), "d1"),
    "d2_shipped_within": (lambda t, pr: shipping.shipped_within(t, pr.shipping_time), "d2"),
}


# Output columns that the jobs compute as exact DECIMAL. The registered queries present
# them as DOUBLE (converted once, at the end, on both engines), so every way of reading
# the results (rows, pandas, Arrow) sees the same numbers. Kept in step with the jobs
# by tests/test_entry.py.
MONEY_COLUMNS: dict[str, tuple[str, ...]] = {
    "b12_followed_products": (),
    "b2_candidate_open_quantities": (),
    "b4_stock_health_snapshots": ('STOCK_VALUE',),
    "b5_season_sales": ('COST_PER_UNIT',),
    "b7_horizon_candidates": ('PURCHASE_PRICE',),
    "b8_bundle_child_quantities": (),
    "b1_contribution_margin": ('shipping_cost_per_shipping_method', 'line_total', 'line_total_ex_vat', 'margin_total_net', 'total_revenue_for_cost_share', 'mktplace_marketing_cost', 'revenue_applicable_for_payment_cost'),
    "b1_eligible_lines": ('line_total', 'line_total_ex_vat', 'margin_total_net', 'bol_fixed_cost_per_product', 'bol_variable_cost_per_product', 'ManoMano_marketing_cost_per_product', 'Amazon_marketing_cost_per_product'),
    "b1_order_rollup": ('total_revenue_for_cost_share', 'shipping_cost_per_shipping_method'),
    "d8_allocated_shipping_cost": ('line_total_ex_vat',),
    "b2_replenishment_list": ('PER_UNIT_COST',),
    "b2_reorder_factors": (),
    "b2_order_counts": (),
    "b2_candidates": ('PER_UNIT_COST',),
    "d9_purchase_check": (),
    "d10_low_stock_report": (),
    "b2_replenishment_list_alternatives": ('PER_UNIT_COST',),
    "b2_replenishment_list_low_cash": ('PER_UNIT_COST',),
    "b3_stock_health": ('PER_UNIT_COST', 'STOCK_VALUE'),
    "b3_stock_health_base": ('PER_UNIT_COST', 'STOCK_VALUE'),
    "b4_stock_health_trend": ('STOCK_VALUE',),
    "d7_bucket_totals": ('STOCK_VALUE', 'SUM_OF_NON_MOVING_42_DAYS', 'SUM_OF_0_30_DGN', 'SUM_OF_31_90_DGN', 'SUM_OF_91_180_DGN', 'SUM_OF_180_365_DGN', 'MORE_THAN_365_DGN', 'SUM_OF_NON_MOVING_365_DAYS'),
    "b5_expected_sales_leaf_blowers": ('COST_PER_UNIT', 'ORDER_VALUE'),
    "b6_expected_sales_lamps": ('COST_PER_UNIT', 'ORDER_VALUE'),
    "b5_expected_sales_leaf_blowers_orderable": ('COST_PER_UNIT', 'ORDER_VALUE'),
    "b6_expected_sales_lamps_orderable": ('COST_PER_UNIT', 'ORDER_VALUE'),
    "b7_expected_sales_horizon": ('PURCHASE_PRICE',),
    "b8_shipped_child_quantities": (),
    "b9_purchase_value": ('TOTAL_PURCHASE_VALUE',),
    "b10_open_purchase_quantities": ('PER_UNIT_COST',),
    "b11_current_stock": ('cost_net',),
    "d4_open_purchase_values": ('ORDERED_VALUE', 'CONFIRMED_VALUE', 'BACKORDER_VALUE', 'RECEIVED_VALUE'),
    "d5_stock_value_totals": ('STOCK_MAGENTO_VALUE', 'STOCK_HBS_VALUE'),
    "b12_out_of_stock_base": ('cost_net',),
    "d3_out_of_stock_percentage": (),
    "b14_stock_development": ('PER_UNIT_COST', 'STOCK_VALUE'),
    "d6_stock_value_per_class": ('STOCK_VALUE',),
    "b13_shipping_lines": ('line_total_ex_vat',),
    "d1_class_shares": ('REVENUE',),
    "d2_shipped_within": (),
}


def present(df: DataFrame) -> DataFrame:
    """Cast the DECIMAL columns of a job result to DOUBLE (column order kept)."""
    return df.select([F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                      else F.col(f.name) for f in df.schema.fields])


def _as_is(pr: Profile) -> Profile:
    return pr


def variant_of(key: str) -> Callable[[Profile], Profile]:
    entry_ = JOBS[key]
    return entry_[2] if len(entry_) > 2 else _as_is


def run(key: str, tables, profile: Profile) -> DataFrame:
    """Registered job ``key`` over ``tables`` with ``profile`` (and the key's variant)."""
    return JOBS[key][0](tables, variant_of(key)(profile))


def oracle_for(key: str, profile: Profile) -> tuple[str, Profile]:
    """(oracle CTE name, profile the oracle SQL must be built with) for ``key``."""
    return JOBS[key][1], variant_of(key)(profile)


def _runner(key: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: present(run(key, _tables(spark, sf_dir), PR))


def entry(spark: SparkSession) -> DataFrame:
    return present(margin.contribution_margin(_tables(spark, SMOKE_DIR), PR.margin))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {key: _runner(key) for key in JOBS} | dict(LLM_QUERIES)
    if corpus_pipeline is not None:
        out["pipeline"] = corpus_pipeline.run
    return out


def oracle_sql() -> dict[str, str]:
    by_profile: dict[int, tuple[Profile, dict[str, str]]] = {}
    for key in JOBS:
        cte, profile = oracle_for(key, PR)
        by_profile.setdefault(id(variant_of(key)), (profile, {}))[1][key] = cte
    out = {}
    for profile, wanted in by_profile.values():
        sql = oracle_queries(profile, sorted(set(wanted.values())))
        out.update({key: _present_sql(sql[cte], MONEY_COLUMNS[key]) for key, cte in wanted.items()})
    out.update(LLM_ORACLE_SQL)
    if corpus_pipeline is not None and corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out


def _present_sql(sql: str, money: tuple[str, ...]) -> str:
    if not money:
        return sql
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in money)
    return f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n) AS presented"
