"""The derived panel does not depend on the session time zone."""

import os

import pytest

from salespanel.plans.panel import raw_tables

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_panel_is_time_zone_free(spark):
    def snapshot():
        src = raw_tables(spark, SF)
        return (sorted(src["train"].collect()), sorted(src["features"].collect()))
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        a = snapshot()
        spark.conf.set("spark.sql.session.timeZone", "Pacific/Kiritimati")
        b = snapshot()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert a == b and len(a[0]) > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_run_sources_scan_the_line_items_once(spark):
    from salespanel.operators.ingest import ingest
    from salespanel.plans.panel import written_sources
    src = written_sources(spark, SF)
    files = ingest(src).inputFiles()
    assert files and not any("lineitem" in f for f in files)
    assert sorted(src["train"].collect()) == sorted(raw_tables(spark, SF)["train"].collect())


def test_state_notices_rewritten_tables(spark, tmp_path):
    from salespanel.plans.queries import _state
    spark.range(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    before = _state(spark, str(tmp_path))
    assert before == _state(spark, str(tmp_path))
    spark.range(4).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert before != _state(spark, str(tmp_path))
