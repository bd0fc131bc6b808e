"""A hot key: one order holding most of the lines.

The margin base joins the lines back to their order rollup. With a hot order the
line side of that sort-merge join has one huge partition; AQE's skew-join handling
splits it (the final plan shows ``skew=true``) and the result is unchanged. The
thresholds are lowered so the local fixture counts as skewed, and broadcasting is
switched off so the join stays a sort-merge join.
"""

from __future__ import annotations

import contextlib
import io
from decimal import Decimal as D

from conftest import line, tables

from shelfwise.plans import margin

SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "8",
}


@contextlib.contextmanager
def conf(spark, values):
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_hot_order_is_split_and_result_is_whole(spark):
    # varied descriptions, so the hot partition does not compress to almost nothing
    hot = [line(order_id=1, product_id=7 + i % 50, description=f"d{i * 7919 % 100003}",
                line_total=D("12.1000"), line_total_ex_vat=D("10.0000")) for i in range(6000)]
    rest = [line(order_id=o, product_id=7, line_total=D("12.1000"), line_total_ex_vat=D("10.0000"))
            for o in range(2, 1002)]
    t = tables(spark, order_lines=hot + rest)
    with conf(spark, SKEW_CONF):
        df = margin.contribution_margin(t)
        rows = df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
    plan = buf.getvalue()
    assert "isFinalPlan=true" in plan
    assert "skew=true" in plan, plan
    assert len(rows) == 7000
    hot_rows = [r for r in rows if r.order_id == 1]
    assert {r.order_line for r in hot_rows} == {6000}
    assert abs(sum(r.cost_fraction for r in hot_rows) - 1.0) < 1e-9


def test_hot_product_is_split_and_result_is_whole(spark):
    hot = [line(order_id=i, product_id=7, description=f"d{i * 7919 % 100003}",
                line_total=D("12.1000"), line_total_ex_vat=D("10.0000")) for i in range(1, 6001)]
    rest = [line(order_id=i, product_id=8 + i % 500, line_total=D("12.1000"), line_total_ex_vat=D("10.0000"))
            for i in range(6001, 7001)]
    t = tables(spark, order_lines=hot + rest,
               channel_commission=[dict(product_id=i, commission_percentage=D("0.1")) for i in range(7, 509)])
    with conf(spark, SKEW_CONF):
        df = margin.eligible_lines(t)
        rows = df.collect()
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
    assert "skew=true" in buf.getvalue(), buf.getvalue()
    assert sorted(r.order_id for r in rows) == list(range(1, 7001))


def test_hot_product_is_split_in_the_rollup_too(spark):
    hot = [line(order_id=i, product_id=7, line_total=D("12.1000"), line_total_ex_vat=D(i * 7919 % 100003) / 100)
           for i in range(1, 6001)]
    rest = [line(order_id=i, product_id=8 + i % 500, line_total=D("12.1000"), line_total_ex_vat=D("10.0000"))
            for i in range(6001, 7001)]
    t = tables(spark, order_lines=hot + rest,
               channel_commission=[dict(product_id=i, commission_percentage=D("0.1")) for i in (7, 7, *range(8, 509))])
    with conf(spark, SKEW_CONF):
        df = margin.order_rollup(t)
        rows = {r.order_id: r.order_line for r in df.collect()}
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            df.explain()
    assert "skew=true" in buf.getvalue(), buf.getvalue()
    assert rows == {i: 2 if i <= 6000 else 1 for i in range(1, 7001)}
