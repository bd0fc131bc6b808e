"""Key checks of the logical tables."""

from __future__ import annotations

from conftest import SF_SMALL, tables

from shelfwise.params import TESTDATA_PROFILE as PR
from shelfwise.sources import testdata
from shelfwise.sources.validate import key_violations


def test_fixture_keys_are_unique(spark):
    assert key_violations(testdata.load(spark, SF_SMALL, PR.as_of)).count() == 0


def test_duplicate_keys_are_reported(spark):
    row = dict(product_id=1, period="year", type="sales", label="A", mean=1.0, absolute=3)
    t = tables(spark, classifications=[row, dict(row, label="B"), dict(row, type="sales_in_stock")],
               products=[dict(product_id=7), dict(product_id=7), dict(product_id=8)])
    got = {(r.table, r.rows) for r in key_violations(t).collect()}
    assert got == {("classifications", 2), ("products", 2)}
