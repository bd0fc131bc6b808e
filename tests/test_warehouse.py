"""The warehouse writer deals the tables kept by day out by the size of each day."""

from __future__ import annotations

import datetime as dt
import os
from decimal import Decimal as D

import pytest
from conftest import tables

from shelfwise.sources.tables import BY_DAY, dealt_by_day, from_warehouse, write_warehouse

LARGE, SMALL = dt.date(2022, 6, 1), dt.date(2022, 6, 2)


def history():
    rows = [dict(product_id=i, date=LARGE, cost_net=D("1.0000"), stock_magento=i % 7) for i in range(2000)]
    rows += [dict(product_id=None, date=LARGE, cost_net=D("2.0000"), stock_magento=i) for i in range(1000)]
    rows += [dict(product_id=i, date=SMALL, cost_net=D("1.0000"), stock_magento=1) for i in range(10)]
    return rows + [dict(product_id=1, date=None, cost_net=D("1.0000"), stock_magento=1)]


@pytest.fixture(autouse=True)
def no_merging(spark):
    """AQE would merge pieces this small into one task."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_large_day_is_written_by_several_tasks(spark, tmp_path):
    """Its bucket number follows from its rows: 3,000 rows of at most 300 a file."""
    t = tables(spark, product_history=history())
    root = str(tmp_path / "w")
    write_warehouse(t, root, rows_per_file=300)
    files = {day: [f for f in os.listdir(f"{root}/product_history/date={day}") if f.endswith(".parquet")]
             for day in (LARGE, SMALL)}
    assert len({f.split("-")[1] for f in files[LARGE]}) > 1  # the task's number
    assert len(files[SMALL]) == 1
    back = from_warehouse(spark, root).product_history.select(*t.product_history.columns)
    assert back.exceptAll(t.product_history).count() == t.product_history.exceptAll(back).count() == 0


def test_buckets_of_a_day(spark):
    t = tables(spark, product_history=history())
    pieces = dealt_by_day(t.product_history, *BY_DAY["product_history"], 300).rdd.glom().collect()
    sizes = [sum(r["date"] == LARGE for r in p) for p in pieces]
    assert sum(sizes) == 3000 and sum(n > 0 for n in sizes) >= 5 and max(sizes) < 1500
