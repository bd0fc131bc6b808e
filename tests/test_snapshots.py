"""Snapshot table writes."""

from __future__ import annotations

import datetime as dt

from conftest import SF_SMALL
from pyspark.sql import functions as F

from shelfwise.params import TESTDATA_PROFILE as PR
from shelfwise.plans import stock_health
from shelfwise.sources import snapshots, testdata


def test_snapshot_rewrite_is_idempotent(spark, tmp_path):
    t = testdata.load(spark, SF_SMALL, PR.as_of)
    path = str(tmp_path / "snapshots")
    day = stock_health.current_snapshot(t, PR.as_of)
    snapshots.write_snapshot(day, path)
    snapshots.write_snapshot(day, path)       # a re-run replaces the day, it does not append
    snapshots.write_snapshot(stock_health.current_snapshot(t, PR.as_of - dt.timedelta(days=1)), path)
    back = snapshots.read_snapshots(spark, path)
    assert back.where(F.col("snapshot_date") == F.lit(PR.as_of)).count() == day.count()
    assert back.select("snapshot_date").distinct().count() == 2
