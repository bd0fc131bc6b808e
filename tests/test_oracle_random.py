"""Every job against its DuckDB oracle on random logical tables.

The driver's fixture is regular (unique dimension keys, no NULL ids). Here the
logical tables are random and small, with NULL keys, NULL values, duplicate
dimension rows, duplicate history rows, several labels per product and, in some
seeds, a NULL parent id or a NULL in the auto-disable list. The only key assumed
unique is (product_id, period, type) of the classifications, the table's key. The
tables are written to Parquet so both engines read the same typed values.
"""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from decimal import Decimal as D

import duckdb
import pytest
from conftest import tables

import __spark_entry__ as E
from oracles.jobs import _needed, job_ctes
from shelfwise import params as P
from shelfwise.sources.tables import from_warehouse, write_warehouse

AS_OF = dt.date(2022, 6, 30)
PROFILE = P.Profile(
    as_of=AS_OF,
    margin=P.MarginParams(from_year=2021),
    leaf_blower=P.SeasonParams(2021, (9, 10, 11, 12), ("%Bladblazer%",), 121),
    lamps=P.SeasonParams(2021, (9, 10, 11, 12), ("%lamp%", "%Lamp"), 122),
    shipped_child=P.ShippedChildParams(year=2022),
    purchase_value=P.PurchaseValueParams(year=2022),
)
IDS = list(range(1, 13))


def m(rng, lo=-50, hi=500):
    return D(rng.randint(lo * 100, hi * 100)) / 100


def q4(x):
    return x.quantize(D("0.0001"))


def pick(rng, values, p_null=0.1):
    return None if rng.random() < p_null else rng.choice(values)


def random_tables(rng, null_parent: bool, null_in_list: bool = False) -> dict:
    ids = IDS
    pid = lambda p=0.05: pick(rng, ids + [-4, -11, 0], p)
    products = []
    for i in ids + [rng.choice(ids), None]:          # one duplicated id, one NULL id
        products.append(dict(
            product_id=i, name_nl=pick(rng, ["a", "b"]), ean="e", status=pick(rng, ["visible", "hidden"], 0.2),
            cost=m(rng, 0, 50), cost_net=m(rng, 0, 40), stock_magento=pick(rng, range(-5, 30), 0.15),
            stock_hbs=rng.randint(0, 9), manufacturer_id=pick(rng, [1, 2, 3]), default_supplier_id=pick(rng, [1, 2, 3, 4]),
            main_category_id=pick(rng, [10, 11, 12])))
    start = AS_OF - dt.timedelta(days=35)
    history = [dict(product_id=pick(rng, ids, 0.02), date=start + dt.timedelta(days=rng.randint(0, 35)),
                    cost_net=m(rng, 0, 40), stock_magento=pick(rng, range(-3, 12), 0.1)) for _ in range(400)]
    history += history[:20]                           # duplicate history rows
    snapshots = [dict(PRODUCT_ID=r["product_id"], snapshot_date=r["date"], STOCK_MAGENTO=r["stock_magento"],
                      STOCK_VALUE=pick(rng, [D("0.00"), m(rng, -20, 400)]),
                      AVG_SALES_IN_STOCK_42_DAYS=pick(rng, [0.0, 0.3, 2.5]),
                      AVG_SALES_IN_STOCK_365_DAYS=pick(rng, [0.0, 0.1]),
                      ESTIMATED_STOCK_DAYS=pick(rng, [0.0, 12.5, 30.0, 30.5, 31.0, 90.0, 150.0, 365.0, 400.0]))
                 for r in history[::3]]
    classes = []
    for i in ids:
        for period in ("week", "42_days", "year"):
            for ctype in ("sales", "sales_in_stock"):
                if rng.random() < 0.75:
                    classes.append(dict(product_id=i, period=period, type=ctype,
                                        label=pick(rng, ["A+", "A", "B", "C", "D"]),
                                        mean=pick(rng, [0.0, 0.01, 0.05, 0.3, 1.005, 2.5, -0.2], 0.1),
                                        absolute=pick(rng, [0, 3, 40], 0.1)))
    lines = []
    for oid in range(1, 60):
        site, method = pick(rng, [3, 4, 6, 7, 8, 14, 99], 0.02), pick(rng, ["pallet", "flatrate_flatrate", "standard"], 0.2)
        day = dt.datetime(2021, 8, 1) + dt.timedelta(days=rng.randint(0, 330))
        for _ in range(rng.randint(1, 4)):
            ex = m(rng, -20, 300)
            if rng.random() < 0.1:                    # a second shipping group in the same order
                method = rng.choice(["pallet", "standard"])
            lines.append(dict(
                order_id=oid, order_date=day, product_id=pid(), description=pick(rng, ["x", "y", "z"]),
                brand=pick(rng, ["Makita", "Festool", "Other"]), category=pick(rng, ["Bladblazer pro", "LED Lamp", "Bureaulamp", "Other"]),
                root_category=pick(rng, ["R1", "R2"]), line_total=q4(ex * D("1.21")), line_total_ex_vat=ex,
                margin_total_net=q4(ex / 4), purchase_net=q4(ex * D("0.7")), qty=pick(rng, [-1, 0, 1, 1, 2, 3, 7], 0.02),
                website_id=site, channel=pick(rng, ["BOL", "ManoMano", "Amazon", "GCNL", "Other"], 0.02),
                shipping_method=method, status=pick(rng, [0, 1, 2, 5], 0.02),
                order_type=pick(rng, ["sales_order", "sales_order", "rma", "follow_up_shipment"], 0.02),
                line_type=pick(rng, ["COMPOSITION", "SIMPLE"]), year_number=day.year,
                day_name=day.strftime("%A"), shipped_in=rng.randint(0, 4)))
    parents = rng.sample(ids, 3)
    set_items = [dict(parent_product_id=p, child_product_id=rng.choice(ids), quantity=rng.randint(1, 3))
                 for p in parents for _ in range(2)]
    if null_parent:
        set_items.append(dict(parent_product_id=None, child_product_id=1, quantity=1))
    flag = lambda n: [dict(product_id=rng.choice(ids)) for _ in range(n)]
    return dict(
        order_lines=lines, products=products, product_history=history, classifications=classes,
        stock_health_snapshots=snapshots,
        product_labels=[dict(product_id=pick(rng, ids, 0.05), label=pick(rng, ["new", "promo", "NONE"], 0.1))
                        for _ in range(10)],
        set_items=set_items,
        manufacturers=[dict(manufacturer_id=1, name="Festool"), dict(manufacturer_id=2, name="Makita"),
                       dict(manufacturer_id=2, name="Makita"), dict(manufacturer_id=3, name=None)],
        suppliers=[dict(supplier_id=1, name="Makita Nederland", type="OEM"),
                   dict(supplier_id=2, name="EOL / Discontinued", type=None),
                   dict(supplier_id=3, name="Other", type="trader")],
        categories=[dict(category_id=10, root_category_id=100, name_nl="Bladblazers"),
                    dict(category_id=11, root_category_id=101, name_nl="Lamps"),
                    dict(category_id=12, root_category_id=None, name_nl="Loose"),
                    dict(category_id=100, root_category_id=None, name_nl="ROOT_A"),
                    dict(category_id=101, root_category_id=None, name_nl="ROOT_B")],
        pending_po=[dict(product_id=pick(rng, ids, 0.05), qty=rng.randint(-5, 20), status_id=rng.choice([2, 3, 4, 5]),
                         deleted_at=None if rng.random() < 0.8 else dt.datetime(2022, 1, 1)) for _ in range(40)],
        channel_commission=[dict(product_id=i, commission_percentage=D("0.0800")) for i in ids if i % 3],
        clearance_products=flag(3), clearance_products_hist=flag(3),
        auto_disable_products=flag(2) + ([dict(product_id=None)] if null_in_list else []),
        bf_assortment_sales=flag(3),
        separate_parcel_products=flag(4) + [dict(product_id=None)],
        min_order_qty=[dict(product_id=rng.choice(ids), minimum_qty=rng.choice([2.5, 3.5, 1.0]))],
        min_desired_qty=[dict(product_id=rng.choice(ids), minimum_desired_qty=4)],
    )


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jobs_match_oracle_on_random_tables(spark, tmp_path, seed):
    rng = random.Random(seed)
    t = tables(spark, **random_tables(rng, null_parent=(seed == 3), null_in_list=(seed == 2)))
    root = str(tmp_path / "warehouse")
    write_warehouse(t, root)
    t = from_warehouse(spark, root)
    con = duckdb.connect()
    for name in t._builders:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}/**/*.parquet', "
                    f"hive_partitioning = true)")
    failures = []
    for key in E.JOBS:
        df = E.run(key, t, PROFILE)
        got = canon([tuple(r) for r in df.collect()], df.columns)
        cte, profile = E.oracle_for(key, PROFILE)
        ctes = job_ctes(profile)
        # the oracle without the adapter: the logical tables are the registered views
        head = ",\n".join(f"{n} AS ({ctes[n]}\n)" for n in _needed(cte, ctes))
        rel = con.sql(f"WITH {head}\nSELECT * FROM {cte}")
        want = canon(rel.fetchall(), rel.columns)
        if got != want:
            failures.append((key, sum(got.values()), sum(want.values())))
    assert not failures, failures
