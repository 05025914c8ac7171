"""The gated run pipeline and the run-history scan."""

from salespanel.plans.pipeline import forecast, run_pipeline
from salespanel.plans.runs import failed_run_errors, failed_run_messages, list_runs, runs_with_status
from salespanel.sources import artifacts as art
from salespanel.sources.raw import load_raw_tables
from tests.conftest import d


def raw(tmp_path):
    import datetime as dt
    lines = ["Store,Dept,Date,Weekly_Sales,IsHoliday"]
    flines = ["Store,Date,Temperature,Fuel_Price,MarkDown1,MarkDown2,MarkDown3,MarkDown4,MarkDown5,CPI,Unemployment,IsHoliday"]
    for s in (1, 2):
        for w in range(20):
            day = d("2010-02-05") + dt.timedelta(days=7 * w)
            txt = day.strftime("%d/%m/%Y")
            flines.append(f"{s},{txt},40,2.5,{'NA' if w < 5 else w},NA,NA,NA,NA,{200 + s},{8 if w % 3 else 'NA'},FALSE")
            for dept in (1, 2):
                lines.append(f"{s},{dept},{txt},{1000 * s + 10 * dept + 5 * w + (w % 4)},{'TRUE' if w == 7 else 'FALSE'}")
    (tmp_path / "stores.csv").write_text("Store,Type,Size\n1,A,100\n2,B,200\n")
    (tmp_path / "features.csv").write_text("\n".join(flines) + "\n")
    (tmp_path / "train.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_pipeline_completes_and_runs_are_listed(spark, tmp_path):
    root = str(tmp_path / "artifacts")
    st = run_pipeline(spark, raw_dir=raw(tmp_path), artifacts_root=root, run_id="20100101T000000Z-aaaa",
                      num_trees=5, max_depth=3)
    assert st.status == "COMPLETED" and st.contract_status == "PASS"
    assert st.selected_model_name in ("Ridge", "RandomForestRegressor")
    assert set(st.extra["findings"]) >= {"profile_summary", "markdown_outliers", "wow_anomalies", "markdown_corr"}
    assert spark.read.parquet(st.extra["findings"]["profile_summary"]).first().row_count == 80
    assert forecast(spark, st.run_dir).count() > 0
    c = art.load_contract(spark, st.contract_path)
    assert c["columns"]["Weekly_Sales"]["max"] == 800000.0 and "max" not in c["columns"]["Store"]

    # a failing gate: a contract whose bounds the data breaks
    bad = dict(c)
    bad["columns"] = {**c["columns"], "Weekly_Sales": {**c["columns"]["Weekly_Sales"], "max": 10.0}}
    st2 = run_pipeline(spark, sources=load_raw_tables(spark, raw(tmp_path)), artifacts_root=root,
                       run_id="20100102T000000Z-bbbb", contract=bad)
    assert st2.status == "FAILED" and any("maximum" in e for e in st2.validation_errors)

    # an unfinished run and an unreadable one
    art.write_document(spark, {"run_id": "x", "started_at": "now"},
                       __import__("salespanel.plans.runs", fromlist=["S"]).STARTED_SCHEMA,
                       f"{root}/20100103T000000Z-cccc/run_started")
    art.write_document(spark, {"run_id": "y", "started_at": "now"},
                       __import__("salespanel.plans.runs", fromlist=["S"]).STARTED_SCHEMA,
                       f"{root}/20100104T000000Z-dddd/run_started")
    (tmp_path / "artifacts" / "20100104T000000Z-dddd" / "run_metadata").mkdir()
    (tmp_path / "artifacts" / "20100104T000000Z-dddd" / "run_metadata" / "part-0.json").write_text("{not json")

    runs = list_runs(spark, root)
    got = [(r.run_id, r.status) for r in runs.collect()]
    assert got == [("20100104T000000Z-dddd", "UNKNOWN"), ("20100103T000000Z-cccc", "IN_PROGRESS"),
                   ("20100102T000000Z-bbbb", "FAILED"), ("20100101T000000Z-aaaa", "COMPLETED")]
    assert [r.run_id for r in runs_with_status(runs, ("COMPLETED",)).collect()] == ["20100101T000000Z-aaaa"]
    errs = failed_run_errors(runs).collect()
    assert errs and all(r.run_id == "20100102T000000Z-bbbb" for r in errs)
    said = failed_run_messages(runs).collect()
    assert [r.message for r in said if r.severity == "error"] == st2.validation_errors
    assert [r.message for r in said if r.severity == "warning"] == st2.validation_warnings
    done = runs.filter("status = 'COMPLETED'").first()
    assert (done.rows_in, done.rows_dropped) == (80, 0)


def test_list_runs_empty(spark, tmp_path):
    assert list_runs(spark, str(tmp_path / "none")).count() == 0


def test_train_only_imputation_fit(spark, tmp_path):
    from pyspark.sql import functions as F
    root = str(tmp_path / "artifacts")
    st = run_pipeline(spark, raw_dir=raw(tmp_path), artifacts_root=root, run_id="20100105T000000Z-eeee",
                      num_trees=3, max_depth=2, impute_fit="train")
    assert st.status == "COMPLETED"
    rep = art.load_evaluation_report(spark, f"{st.run_dir}/evaluation_report")
    assert st.extra["impute_fit_cutoff"] == rep["split_cutoff_date"]
    ft = spark.read.parquet(f"{st.run_dir}/features")
    assert ft.filter(F.col("Unemployment").isNull()).count() == 0


def test_dashboard_pages(spark, tmp_path):
    from salespanel.plans import dashboard
    root = str(tmp_path / "artifacts")
    st = run_pipeline(spark, raw_dir=raw(tmp_path), artifacts_root=root, run_id="20100106T000000Z-ffff",
                      num_trees=3, max_depth=2)
    assert [r.run_id for r in dashboard.eligible_runs(spark, root, "predictive").collect()] == [st.run_id]
    d = dashboard.descriptive(spark, st.run_dir)
    assert d["kpis"].first().stores == 2 and d["markdown_corr"].count() == 36
    p = dashboard.predictive(spark, st.run_dir)
    assert p["selected"].count() == 1 and p["forecast_by_date"].count() > 0


def test_cli_run_and_validate(tmp_path):
    import subprocess
    import sys
    root = str(tmp_path / "artifacts")
    env_cmd = [sys.executable, "-m", "salespanel", "--master", "local[2]", "run", "--raw-dir", raw(tmp_path),
               "--artifacts", root, "--run-id", "20100107T000000Z-gggg"]
    out = subprocess.run(env_cmd, capture_output=True, text=True, timeout=900,
                         cwd=__import__("os").path.dirname(__import__("os").path.dirname(__file__)))
    assert out.returncode == 0, out.stderr[-2000:]
    assert '"status": "COMPLETED"' in out.stdout


def test_every_folder_is_a_run(spark, tmp_path):
    """A run without ``run_started`` counts by its metadata, an empty folder is in progress."""
    (tmp_path / "a" / "run_metadata").mkdir(parents=True)
    (tmp_path / "a" / "run_metadata" / "part-0.json").write_text('{"run_id": "a", "status": "COMPLETED"}')
    (tmp_path / "b").mkdir()
    got = [(r.run_id, r.status) for r in list_runs(spark, str(tmp_path)).collect()]
    assert got == [("b", "IN_PROGRESS"), ("a", "COMPLETED")]
