"""How the history jobs grow: size estimates, rows per task, shuffles of the history."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from conftest import frame, tables
from shelfwise.conf import SCALE_CONF, split_shuffles
from shelfwise.operators.relational import not_in, not_in_by_key
from shelfwise import schemas
from shelfwise.params import TESTDATA_PROFILE as PR
from shelfwise.plans import history, replenishment
from shelfwise.sources import testdata
from shelfwise.sources.tables import Tables

AS_OF = dt.date(2022, 3, 1)


def part(spark, n):
    return spark.createDataFrame([(k, k % 50, 900.0 + k) for k in range(n)],
                                 "p_partkey long, p_size int, p_retailprice double")


def estimate(df, capsys) -> float:
    """Bytes the optimizer expects of ``df``."""
    capsys.readouterr()
    df.explain("cost")
    size, unit = re.search(r"sizeInBytes=([\d.E+]+) (\w+)", capsys.readouterr().out).groups()
    return float(size) * 1024 ** ["B", "KiB", "MiB", "GiB", "TiB"].index(unit)


def test_generated_history_is_not_taken_for_small(spark, capsys):
    """The optimizer broadcast 28 days of every product, whose estimate was that of the products."""
    parts = part(spark, 3000)
    hist = testdata.product_history(parts, AS_OF).select("product_id", "stock_magento")
    assert estimate(hist, capsys) >= 3000 * 101 * 16


@pytest.mark.parametrize("rows", [0, 1, 40])
def test_history_is_generated_by_tasks_of_bounded_size(spark, monkeypatch, rows):
    monkeypatch.setattr(testdata, "ROWS_PER_TASK", 500)
    hist = testdata.product_history(part(spark, rows).coalesce(1), AS_OF)
    pieces = [len(x) for x in hist.rdd.glom().collect()]
    assert sum(pieces) == rows * 101 and max(pieces, default=0) <= 1010
    start = AS_OF - dt.timedelta(days=100)
    got = {(r.product_id, r.date): r.stock_magento for r in hist.collect()}
    assert got == {(k + 1, start + dt.timedelta(days=d)): None if k % 53 == 0 else k % 50 - 10 + (k + d) % 15 - 7
                   for k in range(rows) for d in range(101)}


def test_shuffle_pieces_stay_small():
    """Compressed history rows take about 20 times as much in the task that sorts them."""
    assert SCALE_CONF["spark.sql.adaptive.advisoryPartitionSizeInBytes"] == "16MB"


def test_stock_development_shuffles_the_history_once_and_sorts_once(spark, capsys):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        capsys.readouterr()
        history.stock_development(tables(spark)).explain("formatted")
        plan = capsys.readouterr().out
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", SCALE_CONF["spark.sql.autoBroadcastJoinThreshold"])
    assert plan.count("rangepartitioning(") == 1
    assert not re.search(r"hashpartitioning\([^\n]*(?i:stock_magento)", plan)
    assert len(re.findall(r"REPARTITION_BY_COL", plan)) == 1


@pytest.mark.parametrize("listed", [[], [2], [None], [2, None]])
def test_exclusion_by_key_is_not_in(spark, listed):
    rows = frame(spark, "product_history", [dict(product_id=k, stock_magento=s) for k in (None, 1, 2, 2, 3) for s in (1, 1, 2)])
    excluded = spark.createDataFrame([(x,) for x in listed], "k long")
    got, want = not_in_by_key(rows, "product_id", excluded, "k"), not_in(rows, "product_id", excluded, "k")
    assert got.columns == want.columns
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_side_over_ten_megabytes_is_not_broadcast(spark):
    """The driver builds each broadcast table; sides up to 64 MB by estimate went through it."""
    big, side = spark.range(4_000_000), spark.range(1_500_000)   # side: 12 MB
    plan = big.join(side, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert SCALE_CONF["spark.sql.adaptive.autoBroadcastJoinThreshold"] == "10MB"


@pytest.mark.parametrize("rows, pieces", [(1, 4), (2_000_000, 4), (2_500_001, 6), (727_200_000, 1455)])
def test_shuffles_start_from_pieces_of_bounded_rows(spark, rows, pieces):
    """200 pieces of the history of 7.2 million products were 3.6 million rows each."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        split_shuffles(spark, rows)
        assert int(spark.conf.get(name)) == pieces
        plan = part(spark, 9).groupBy("p_size").count()._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\(p_size#\d+, {pieces}\)", plan)
    finally:
        spark.conf.unset(name)


def test_snapshots_shuffle_the_history_once(spark, capsys):
    """The parent test and the means each shuffled it when neither side could be broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = tables(spark)
        df = testdata.stock_health_snapshots(t.product_history, t.classifications, t.set_items)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", SCALE_CONF["spark.sql.autoBroadcastJoinThreshold"])
    assert len(re.findall(r"REPARTITION_BY_COL", plan)) == 1
    assert "hashpartitioning(coalesce(product_id" not in plan.split("REPARTITION_BY_COL")[0]


@pytest.mark.parametrize("parents", [[], [2], [None], [2, None]])
def test_snapshots_leave_out_parents_as_not_in_does(spark, parents):
    """NOT IN keeps a row without a product only when no parent is listed, and repeats stay."""
    t = tables(spark, product_history=[dict(product_id=k, stock_magento=s) for k in (None, 1, 2, 2, 3) for s in (1, 1, 0)],
               set_items=[dict(parent_product_id=p) for p in parents])
    got = testdata.stock_health_snapshots(t.product_history, t.classifications, t.set_items)
    kept = [None, 1, 2, 2, 3] if not parents else [] if None in parents else [1, 3]
    assert sorted((r.product_id or 0) for r in got.select(F.col("PRODUCT_ID").alias("product_id")).collect()) == sorted(2 * [k or 0 for k in kept])


def one_of_each(spark):
    """Tables of one row each, of a size that the optimizer knows; every value is 1."""
    return Tables.from_frames(**{
        name: spark.range(1, 2).select([
            (F.timestamp_seconds("id") if f.dataType.typeName() in ("date", "timestamp", "timestamp_ntz") else F.col("id"))
            .cast(f.dataType).alias(f.name) for f in schema.fields])
        for name, schema in schemas.TABLES.items()})


@pytest.mark.parametrize("options", [{}, {"exclude_black_friday": True}])
def test_replenishment_lookups_by_product_are_not_broadcast(spark, options):
    """About ten of them, each under the limit, met in the driver."""
    df = replenishment.replenishment_list(one_of_each(spark), replace(PR.replenishment, **options))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?i)SortMergeJoin[^\n]*product_id", plan)) >= 9
    assert not re.search(r"(?i)BroadcastHashJoin \[(coalesce\()?_?product_id", plan)


def test_order_lines_do_not_broadcast_large_tables(spark, monkeypatch):
    lineitem = spark.createDataFrame(
        [(k, k % 3, 1, 2.0, 100.0, 0.1, "N") for k in range(6)],
        "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
        "l_discount double, l_returnflag string")
    orders = spark.createDataFrame([(k, k, "F", dt.datetime(2022, 1, 1)) for k in range(5)],
                                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp")
    parts = spark.createDataFrame([(k, "p", "Brand#1", "SMALL", k) for k in range(2)],
                                  "p_partkey long, p_name string, p_brand string, p_type string, p_size int")
    small = testdata.order_lines(lineitem, orders, parts)
    monkeypatch.setattr(testdata, "BROADCAST_ROWS", 1)
    large = testdata.order_lines(lineitem, orders, parts)
    plan = large._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan
    assert sorted(small.collect()) == sorted(large.collect()) and large.count() == 4


def test_out_of_stock_products_are_joined_apart_from_the_history(spark):
    """One task sorted the products for all their joins and the history's rows."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = history.out_of_stock_base(one_of_each(spark), PR.out_of_stock)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", SCALE_CONF["spark.sql.autoBroadcastJoinThreshold"])
    assert len(re.findall(r"hashpartitioning\(xxhash64\(_[ef]pid#\d+L, 42\), \d+\), REPARTITION_BY_COL", plan)) == 2
