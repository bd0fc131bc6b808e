"""The command-line entry point writes a job's result over a warehouse."""

from __future__ import annotations

from dataclasses import replace

from conftest import SF_SMALL

from shelfwise.__main__ import JOBS, main, profile_for
from shelfwise.params import TESTDATA_PROFILE as PR
from shelfwise.plans import margin, purchase
from shelfwise.sources import testdata
from shelfwise.sources.tables import from_warehouse, write_warehouse


def test_cli_writes_the_job_result(spark, tmp_path):
    root, out = str(tmp_path / "warehouse"), str(tmp_path / "out")
    write_warehouse(testdata.load(spark, SF_SMALL, PR.as_of), root)
    main(["margin", "--warehouse", root, "--as-of", PR.as_of.isoformat(), "--out", out, "--testdata-years"])
    written = spark.read.parquet(out)
    expected = margin.contribution_margin(from_warehouse(spark, root), PR.margin)
    assert written.count() == expected.count() > 0
    assert written.exceptAll(expected).count() == 0
    assert len(JOBS) >= 20


def test_cli_snapshot_then_trend(spark, tmp_path):
    import datetime as dt
    root, snaps, out = (str(tmp_path / n) for n in ("warehouse", "snapshots", "trend"))
    write_warehouse(testdata.load(spark, SF_SMALL, PR.as_of), root)
    for day in (PR.as_of - dt.timedelta(days=1), PR.as_of, PR.as_of):   # the repeat replaces its day
        main(["stock-health-snapshot", "--warehouse", root, "--as-of", day.isoformat(), "--out", snaps])
    main(["stock-health-trend", "--warehouse", root, "--as-of", PR.as_of.isoformat(),
          "--snapshots", snaps, "--out", out])
    trend = spark.read.parquet(out)
    assert trend.select("snapshot_date").distinct().count() == 2
    assert trend.count() == 2 * spark.read.parquet(snaps).where(f"snapshot_date = '{PR.as_of}'").count()
    assert "SUM_OF_0_30_DGN" in trend.columns


def test_cli_other_years(spark, tmp_path):
    root, out = str(tmp_path / "warehouse"), str(tmp_path / "out")
    write_warehouse(testdata.load(spark, SF_SMALL, PR.as_of), root)
    common = ["--warehouse", root, "--as-of", PR.as_of.isoformat(), "--out", out]
    main(["purchase-value", *common, "--year", "1999"])
    expected = purchase.purchase_value(from_warehouse(spark, root), replace(PR.purchase_value, year=1999))
    written = spark.read.parquet(out)
    assert written.count() == expected.count() > 0
    assert written.exceptAll(expected).count() == 0
    pr = profile_for(PR.as_of, False, 1998, 1997)
    assert (pr.margin.from_year, pr.shipped_child.year, pr.purchase_value.year) == (1998,) * 3
    assert (pr.leaf_blower.year, pr.lamps.year) == (1997,) * 2
