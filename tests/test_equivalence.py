"""The DataFrame rewrites against the literal SQL forms, on random inputs with NULLs.

- null-aware NOT IN as scalar guards + hash anti join  vs  SQL ``NOT IN (subquery)``
- one conditional aggregate for the open purchase statuses (O5)  vs  four scans
- one pivot of the classification slices (O6)  vs  one left join per slice
- the hoisted anti join of the replenishment filter (O7)  vs  the OR of two NOT INs
"""

from __future__ import annotations

import random
from collections import Counter

import pytest
from conftest import frame
from pyspark.sql import functions as F

from shelfwise.operators.relational import (
    OPEN_PO_ALL, class_wide, exclude_parents, not_in, not_in_all, with_not_in_truth, with_open_po,
)

SEEDS = range(8)


def maybe(rng, value, p_null=0.15):
    return None if rng.random() < p_null else value


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", SEEDS)
def test_not_in_matches_sql(spark, seed):
    rng = random.Random(seed)
    left = spark.createDataFrame([(maybe(rng, rng.randint(0, 9)), i) for i in range(12)], "k long, i long")
    mode = seed % 3   # 0: with NULLs, 1: no NULLs, 2: empty subquery
    sub_rows = [] if mode == 2 else [(maybe(rng, rng.randint(0, 9), 0.3 if mode == 0 else 0.0),)
                                     for _ in range(5)]
    sub = spark.createDataFrame(sub_rows, "s long")
    left.createOrReplaceTempView("l_eq")
    sub.createOrReplaceTempView("s_eq")
    expected = rows_of(spark.sql("SELECT * FROM l_eq WHERE k NOT IN (SELECT s FROM s_eq)"))
    assert rows_of(not_in(left, "k", sub, "s")) == expected


@pytest.mark.parametrize("seed", SEEDS)
def test_not_in_all_matches_conjunction_of_not_ins(spark, seed):
    rng = random.Random(100 + seed)
    left = spark.createDataFrame([(maybe(rng, rng.randint(0, 9)), i) for i in range(12)], "k long, i long")
    subs = []
    for j in range(3):
        empty = rng.random() < 0.3
        with_null = rng.random() < 0.2
        rows = [] if empty else [(maybe(rng, rng.randint(0, 9), 0.5 if with_null else 0.0),) for _ in range(3)]
        sub = spark.createDataFrame(rows, "s long")
        sub.createOrReplaceTempView(f"s{j}_all")
        subs.append((sub, "s"))
    left.createOrReplaceTempView("l_all")
    expected = rows_of(spark.sql("SELECT * FROM l_all WHERE k NOT IN (SELECT s FROM s0_all) "
                                 "AND k NOT IN (SELECT s FROM s1_all) AND k NOT IN (SELECT s FROM s2_all)"))
    assert rows_of(not_in_all(left, "k", subs)) == expected


@pytest.mark.parametrize("seed", SEEDS)
def test_not_in_truth_inside_an_or(spark, seed):
    rng = random.Random(200 + seed)
    left = spark.createDataFrame([(maybe(rng, rng.randint(0, 9)), maybe(rng, rng.random() < 0.5),
                                   maybe(rng, rng.random() < 0.3)) for _ in range(14)], "k long, c boolean, d boolean")
    mode = seed % 3
    sub = spark.createDataFrame([] if mode == 2 else [(maybe(rng, rng.randint(0, 9), 0.4 if mode == 0 else 0.0),)
                                                      for _ in range(4)], "s long")
    left.createOrReplaceTempView("l_or")
    sub.createOrReplaceTempView("s_or")
    expected = rows_of(spark.sql("SELECT * FROM l_or WHERE (k NOT IN (SELECT s FROM s_or) AND c) OR d"))
    ours = with_not_in_truth(left, "k", sub, "s", "_t").where((F.col("_t") & F.col("c")) | F.col("d"))
    assert rows_of(ours.drop("_t")) == expected


def random_po(spark, rng, n_products=6):
    rows = [dict(product_id=maybe(rng, rng.randint(1, n_products), 0.1), qty=maybe(rng, rng.randint(-5, 20), 0.1),
                 status_id=rng.choice([2, 3, 4, 5, 6]),
                 deleted_at=None if rng.random() < 0.7 else __import__("datetime").datetime(2022, 1, 1))
            for _ in range(25)]
    return frame(spark, "pending_po", rows)


@pytest.mark.parametrize("seed", SEEDS)
def test_open_po_pivot_matches_four_scans(spark, seed):
    rng = random.Random(seed)
    po = random_po(spark, rng)
    base = spark.createDataFrame([(maybe(rng, i, 0.1), i * 10) for i in range(1, 6)], "PRODUCT_ID long, c long")
    po.createOrReplaceTempView("po_eq")
    base.createOrReplaceTempView("base_eq")
    scans = {name: f"""(SELECT DISTINCT product_id, CASE WHEN status_id = {code} THEN SUM(qty) ELSE 0 END AS v
                         FROM po_eq WHERE product_id IN (SELECT PRODUCT_ID FROM base_eq)
                           AND status_id = {code} AND deleted_at IS NULL GROUP BY status_id, product_id)"""
             for name, code in OPEN_PO_ALL.items()}
    literal = spark.sql(f"""
        SELECT DISTINCT b.PRODUCT_ID, b.c,
               CASE WHEN o.v IS NULL THEN 0 ELSE o.v END AS ORDERED,
               CASE WHEN c.v IS NULL THEN 0 ELSE c.v END AS CONFIRMED,
               CASE WHEN k.v IS NULL THEN 0 ELSE k.v END AS BACKORDER,
               CASE WHEN r.v IS NULL OR r.v < 0 THEN 0 ELSE r.v END AS RECEIVED
        FROM base_eq b
        LEFT JOIN {scans['ORDERED']} o ON b.PRODUCT_ID = o.product_id
        LEFT JOIN {scans['CONFIRMED']} c ON b.PRODUCT_ID = c.product_id
        LEFT JOIN {scans['BACKORDER']} k ON b.PRODUCT_ID = k.product_id
        LEFT JOIN {scans['RECEIVED']} r ON b.PRODUCT_ID = r.product_id""")
    ours = with_open_po(base, po, OPEN_PO_ALL, floor_negative=("RECEIVED",)).select(
        "PRODUCT_ID", "c", "ORDERED", "CONFIRMED", "BACKORDER", "RECEIVED").distinct()
    assert rows_of(ours) == rows_of(literal)


@pytest.mark.parametrize("seed", SEEDS)
def test_class_pivot_matches_slice_joins(spark, seed):
    rng = random.Random(seed)
    keys = {(pid, period, ctype) for pid in range(1, 7) for period in ("year", "42_days", "week")
            for ctype in ("sales", "sales_in_stock") if rng.random() < 0.6}
    cls = frame(spark, "classifications", [
        dict(product_id=pid, period=period, type=ctype, label=maybe(rng, rng.choice(["A", "B", "D"])),
             mean=maybe(rng, rng.random()), absolute=maybe(rng, rng.randint(0, 9)))
        for pid, period, ctype in sorted(keys)])
    base = spark.createDataFrame([(i,) for i in range(0, 8)], "product_id long")
    base.createOrReplaceTempView("p_eq")
    cls.createOrReplaceTempView("c_eq")
    literal = spark.sql("""
        SELECT p.product_id, a.label AS yl, a.mean AS ym, b.mean AS m42, c.label AS l42s
        FROM p_eq p
        LEFT JOIN c_eq a ON a.product_id = p.product_id AND a.period = 'year' AND a.type = 'sales'
        LEFT JOIN c_eq b ON b.product_id = p.product_id AND b.period = '42_days' AND b.type = 'sales'
        LEFT JOIN c_eq c ON c.product_id = p.product_id AND c.period = '42_days' AND c.type = 'sales_in_stock'""")
    wide = class_wide(cls, [(("year", "sales"), "label", "yl"), (("year", "sales"), "mean", "ym"),
                            (("42_days", "sales"), "mean", "m42"),
                            (("42_days", "sales_in_stock"), "label", "l42s")]).withColumnRenamed("product_id", "k")
    ours = base.join(wide, base.product_id == wide.k, "left").select("product_id", "yl", "ym", "m42", "l42s")
    assert rows_of(ours) == rows_of(literal)


@pytest.mark.parametrize("seed", SEEDS)
def test_hoisted_parent_filter_matches_or_of_not_ins(spark, seed):
    rng = random.Random(seed)
    products = spark.createDataFrame(
        [(maybe(rng, i, 0.1), maybe(rng, rng.choice(["A", "C", "D"])), maybe(rng, rng.randint(-3, 3)))
         for i in range(1, 9)], "product_id long, cls string, stock long")
    labels = spark.createDataFrame([(maybe(rng, rng.randint(1, 8), 0.2), maybe(rng, rng.choice(["new", "promo"])))
                                    for _ in range(6)], "product_id long, label string")
    parents = spark.createDataFrame([(maybe(rng, rng.randint(1, 8), 0.2 if seed % 2 else 0.0),)
                                     for _ in range(3)], "parent_product_id long")
    for name, df in (("pr_eq", products), ("lb_eq", labels), ("si_eq", parents)):
        df.createOrReplaceTempView(name)
    literal = spark.sql("""
        SELECT p.product_id, p.cls, p.stock, l.label FROM pr_eq p LEFT JOIN lb_eq l ON p.product_id = l.product_id
        WHERE (p.product_id NOT IN (SELECT parent_product_id FROM si_eq)
               AND (p.cls IN ('A', 'C') OR (p.cls = 'D' AND p.stock < 0)))
           OR (l.label = 'new' AND l.product_id NOT IN (SELECT parent_product_id FROM si_eq))""")
    kept = exclude_parents(products, parents)
    lab = labels.withColumnRenamed("product_id", "lp")
    joined = kept.join(lab, kept.product_id == lab.lp, "left")
    ours = joined.where(F.col("cls").isin("A", "C") | ((F.col("cls") == "D") & (F.col("stock") < 0))
                        | (F.col("label") == "new")).select("product_id", "cls", "stock", "label")
    assert rows_of(ours) == rows_of(literal)


def test_class_pivot_refuses_a_second_row_of_a_slice(spark):
    rows = [(1, "year", "sales", "A"), (1, "year", "sales", "B"), (None, "year", "sales", "A"), (None, "year", "sales", "B")]
    cls = spark.createDataFrame(rows, "product_id long, period string, type string, label string")
    spec = [(("year", "sales"), "label", "yl")]
    with pytest.raises(Exception, match="several rows of"):
        class_wide(cls, spec).collect()
    assert class_wide(cls.where("product_id is null or label = 'A'"), spec).collect() == [(1, "A")]
