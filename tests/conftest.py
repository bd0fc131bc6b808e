from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from shelfwise import schemas  # noqa: E402
from shelfwise.conf import local_session  # noqa: E402
from shelfwise.sources.tables import Tables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, app="shelfwise-tests")
    yield session
    session.stop()


def frame(spark, name: str, rows=()):
    """A DataFrame with the logical schema of table ``name`` from tuples or dicts."""
    schema = schemas.TABLES[name]
    fixed = []
    for row in rows:
        if isinstance(row, dict):
            row = tuple(row.get(f.name) for f in schema.fields)
        fixed.append(tuple(row))
    return spark.createDataFrame(fixed, schema)


def tables(spark, **rows) -> Tables:
    """Logical tables from hand-made rows; tables not given are empty."""
    return Tables.from_frames(**{name: frame(spark, name, rows.get(name, ())) for name in schemas.TABLES})


def ts(y, m, d):
    return dt.datetime(y, m, d)


def line(**kw):
    """An order line with defaults that pass the margin filters."""
    base = dict(order_id=1, order_date=ts(2022, 3, 1), product_id=7, description="d", brand="b",
                category="c", root_category="r", line_total=None, line_total_ex_vat=None,
                margin_total_net=None, purchase_net=None, qty=1, website_id=7, channel="GCNL",
                shipping_method="standard", status=5, order_type="sales_order", line_type="SIMPLE",
                year_number=2022, day_name="Monday", shipped_in=1)
    base.update(kw)
    return base
