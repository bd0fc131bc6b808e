"""The driver contract: entry(), queries() and oracle_sql(), and parity at sf0.001."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest
from conftest import SF_SMALL

import __spark_entry__ as E
from oracles.jobs import oracle_queries
from shelfwise.plans.margin import OUTPUT

DRIVER_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
                 "benchmark labels conversations").split()


def test_entry_runs_on_the_smoke_tables(spark):
    df = E.entry(spark)
    assert tuple(df.columns) == OUTPUT
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(E.JOBS) <= set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 30


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        path = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("key", sorted(E.JOBS))
def test_query_matches_oracle(spark, duck, key):
    df = E.queries()[key](spark, SF_SMALL)
    rel = duck.sql(E.oracle_sql()[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(rel.fetchall(), rel.columns)


# the last step of each sorting report: its column (descending) and the declared tie-breakers
REPORT_ORDER = {
    "b2_replenishment_list": ("ORDER_QTY", "PRODUCT_ID"),
    "b2_replenishment_list_alternatives": ("ORDER_QTY", "PRODUCT_ID"),
    "b2_replenishment_list_low_cash": ("ORDER_QTY", "PRODUCT_ID"),
    "b3_stock_health": ("STOCK_VALUE", "PRODUCT_ID"),
    "b5_expected_sales_leaf_blowers": ("ORDER_VALUE", "PRODUCT_ID", "CATEGORY", "ROOT_CATEGORY"),
    "b6_expected_sales_lamps": ("ORDER_VALUE", "PRODUCT_ID", "CATEGORY", "ROOT_CATEGORY"),
    "b5_expected_sales_leaf_blowers_orderable": ("ORDER_VALUE", "PRODUCT_ID", "CATEGORY", "ROOT_CATEGORY"),
    "b6_expected_sales_lamps_orderable": ("ORDER_VALUE", "PRODUCT_ID", "CATEGORY", "ROOT_CATEGORY"),
    "b7_expected_sales_horizon": ("ORDER_VALUE", "PRODUCT_ID", "ROOT_CATEGORY"),
    "b8_shipped_child_quantities": ("quantity_sold", "product_id", "country", "category", "root_category"),
    "b14_stock_development": ("STOCK_VALUE", "PRODUCT_ID", "DATE"),
    "d10_low_stock_report": ("LOW_STOCK_PERCENTAGE_DAYS", "PRODUCT_ID"),
}


@pytest.mark.parametrize("key", sorted(REPORT_ORDER))
def test_rows_come_out_as_the_oracle_orders_them(spark, duck, key):
    """CORRECTNESS compares multisets; this compares the sequences of the sort keys."""
    first, *ties = REPORT_ORDER[key]
    order = ", ".join([f'"{first}" DESC NULLS LAST', *[f'"{c}" ASC NULLS LAST' for c in ties]])
    got = [tuple(r[c] for c in REPORT_ORDER[key]) for r in E.queries()[key](spark, SF_SMALL).collect()]
    columns = ", ".join(f'"{c}"' for c in REPORT_ORDER[key])
    assert len(got) > 1
    assert got == duck.sql(f"SELECT {columns} FROM ({E.oracle_sql()[key]}) AS report ORDER BY {order}").fetchall()


@pytest.mark.parametrize("key", sorted(k for k, money in E.MONEY_COLUMNS.items() if money))
def test_money_is_exact_to_the_scale_and_unit(spark, duck, key):
    """Before they are presented as DOUBLE: precision, scale and unscaled values of every money
    column, as the job and its oracle return them."""
    df = E.run(key, E._tables(spark, SF_SMALL), E.PR)
    cte, profile = E.oracle_for(key, E.PR)
    rel = duck.sql(oracle_queries(profile, [cte])[cte])
    for name in E.MONEY_COLUMNS[key]:
        spark_type = df.schema[name].dataType
        assert str(rel.types[rel.columns.index(name)]) == f"DECIMAL({spark_type.precision},{spark_type.scale})", name

    def unscaled(rows, names):
        at = [list(names).index(n) for n in E.MONEY_COLUMNS[key]]
        return Counter(tuple(None if r[i] is None else (int(r[i].scaleb(-r[i].as_tuple().exponent)),
                                                        -r[i].as_tuple().exponent) for i in at) for r in rows)

    assert unscaled(df.collect(), df.columns) == unscaled(rel.fetchall(), rel.columns)


def test_money_columns_list_matches_the_jobs(spark):
    """MONEY_COLUMNS (used to build the oracle casts) lists exactly the DECIMAL outputs,
    and the registered queries present no DECIMAL column."""
    from pyspark.sql.types import DecimalType

    from shelfwise.sources import testdata
    t = testdata.load(spark, SF_SMALL, E.PR.as_of)
    for key in E.JOBS:
        df = E.run(key, t, E.PR)
        assert tuple(f.name for f in df.schema.fields if isinstance(f.dataType, DecimalType)) \
            == E.MONEY_COLUMNS[key], key
        assert not any(isinstance(f.dataType, DecimalType) for f in E.present(df).schema.fields)
