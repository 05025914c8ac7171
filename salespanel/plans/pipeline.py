"""The end-to-end run: ingest -> analyse -> contract gate -> features ->
train and select -> artifacts, one folder per run.

Each stage reads what the previous one wrote to the run folder (tables as
Parquet, documents as JSON), so lineage is cut at every stage boundary: a
lost executor only recomputes from the last written table, never from the
raw sources. The run folder lives under the shared directory named by
``spark.checkpoint.dir`` unless an artifacts root is given.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from salespanel.operators import contract as con
from salespanel.operators import features as feat
from salespanel.operators import ingest as ing
from salespanel.operators import insight
from salespanel.operators import inspect as insp
from salespanel.operators import model as mdl
from salespanel.operators import multigrain
from salespanel.operators import profile as prof
from salespanel.operators.onerow import run_together
from salespanel.plans.runs import STARTED_SCHEMA
from salespanel.session import shared_dir
from salespanel.sources import artifacts as art
from salespanel.sources.raw import load_raw_tables, read_clean, write_series


@dataclass
class RunState:
    # field names as in RUN_METADATA_SCHEMA (fixed values)
    run_id: str = ""
    run_dir: str = ""
    status: str = "PENDING"
    clean_data_path: str = ""
    contract_path: str = ""
    contract_status: str = ""
    validation_errors: list[str] = field(default_factory=list)
    validation_warnings: list[str] = field(default_factory=list)
    selected_model_name: str = ""
    candidate_metrics: dict[str, dict[str, float]] = field(default_factory=dict)
    started_at: str = ""
    finished_at: str = ""
    rows_in: int = 0
    rows_dropped: int = 0
    extra: dict[str, Any] = field(default_factory=dict)

    def metadata(self) -> dict[str, Any]:
        d = asdict(self)
        d.pop("extra")
        return d


def new_run_id() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y%m%dT%H%M%SZ") + "-" + uuid.uuid4().hex[:8]


def _now() -> str:
    return dt.datetime.now(dt.timezone.utc).isoformat()


def _write_all(tables: dict[str, DataFrame], run_dir: str, out: dict[str, str], workers: int) -> None:
    """Write independent tables concurrently: each is its own Spark job, and
    jobs submitted from several driver threads overlap (the scheduler shares
    the executors between them)."""
    def put(item):
        name, df = item
        path = f"{run_dir}/findings/{name}"
        art.write_table(df, path)
        return name, path
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        for name, path in pool.map(put, tables.items()):
            out[name] = path


def analyse(spark: SparkSession, clean: DataFrame, run_dir: str,
            lagged: DataFrame | None = None, workers: int = 4) -> dict[str, str]:
    """Write every finding as a Parquet table; return name -> path.

    All one-row findings (profile, null profile, sign counts, holiday impact,
    KPIs, markdown effect, contract bounds) come from ONE aggregation pass
    over the clean table (few enough buffer fields to stay code-generated),
    those of several rows from ONE aggregation by grouping sets
    (``multigrain.grains``), and the record-level lists from ONE scan
    (``multigrain.samples``), which needs the markdown fences first. Each is
    written once and projected into its findings. Besides these the
    correlations read the table (twice), and the week-over-week swings the
    (Store, Dept) window, which is computed once and feeds the features later.
    Independent findings are written concurrently, in dependency order.
    """
    out: dict[str, str] = {}
    specs = {
        "profile_summary": prof.profile_summary_spec(clean),
        "null_profile": prof.null_profile_spec(clean),
        "sales_sign_counts": insp.sales_sign_counts_spec(clean),
        "holiday_impact": insight.holiday_impact_spec(clean),
        "kpis": insight.kpis_spec(clean),
        "contract_bounds": con.contract_bounds_spec(clean, with_rows=True),
        # the means are aggregated here; the finish that adds the outlier
        # counts is rebuilt below, once those tables exist
        "markdown_effect": insight.markdown_effect_spec(clean),
    }
    wide, finish = run_together(clean, specs)
    wow = (insp.wow_anomalies(clean) if lagged is None
           else insp.wow_anomalies(insp.prev_from_lags(lagged), prepared=True))
    md = insight.markdown_columns(clean)
    rows = Observation("grains")
    grains = multigrain.grains(clean).observe(rows, F.count(F.lit(1)).alias("n"))
    _write_all({"_grains": grains, "_one_pass": wide, "wow_anomalies": wow,
                "markdown_corr": insight.markdown_corr(clean)}, run_dir, out, workers)
    g = spark.read.parquet(out.pop("_grains"))
    _write_all({"markdown_iqr_bounds": multigrain.markdown_iqr_bounds(g, rows.get["n"], md) if md else insp.markdown_iqr_bounds(clean),
                "dept_top10": multigrain.dept_top10(g), "monthly_trend": multigrain.monthly_trend(g),
                "holiday_spikes": multigrain.holiday_spikes(g) if "IsHoliday" in clean.columns else insp.holiday_spikes(clean)},
               run_dir, out, workers)

    above = Observation("samples")
    bounds = spark.read.parquet(out["markdown_iqr_bounds"])
    _write_all({"_samples": multigrain.samples(clean, bounds, above)}, run_dir, out, 1)
    found = spark.read.parquet(out.pop("_samples"))
    n_above = spark.createDataFrame([(above.get["rows_above_fence"],)], "rows_above_fence long")
    _write_all({"zero_sales": multigrain.sales_sample(found, multigrain.ZERO),
                "negative_sales": multigrain.sales_sample(found, multigrain.NEGATIVE),
                "markdown_outliers": multigrain.markdown_outliers(found, md) if md else insp.markdown_outliers(clean),
                "rows_above_fence": n_above}, run_dir, out, workers)

    one = spark.read.parquet(out.pop("_one_pass"))
    finish["markdown_effect"] = insight.markdown_effect_spec(
        clean, spark.read.parquet(out["markdown_outliers"]), spark.read.parquet(out["rows_above_fence"])).finish
    _write_all({name: fn(one) for name, fn in finish.items()}, run_dir, out, workers)
    return out


def run_pipeline(spark: SparkSession, raw_dir: str | None = None,
                 sources: dict[str, DataFrame] | None = None,
                 artifacts_root: str | None = None, run_id: str | None = None,
                 num_trees: int = mdl.FOREST_TREES, max_depth: int = mdl.FOREST_MAX_DEPTH,
                 max_bins: int = mdl.FOREST_MAX_BINS, csv_path: str | None = None,
                 contract: dict[str, Any] | None = None, impute_fit: str = "all",
                 unknown_bool: str = "null") -> RunState:
    """Run everything for one data set. Pass ``raw_dir`` (three CSVs) or
    ``sources`` ({stores, features, train} DataFrames). A FAIL verdict stops
    before training and records FAILED.

    ``impute_fit``: ``"all"`` learns the CPI / Unemployment fill medians
    from every week, as the reference does (the hold-out weeks leak into the
    fill); ``"train"`` learns them from the training weeks only.

    ``num_trees``, ``max_depth`` and ``max_bins`` size the forest.
    ``csv_path`` also exports the clean table as CSV there.

    ``unknown_bool``: what unrecognised IsHoliday text in the CSVs becomes,
    ``"null"`` (caught by the contract) or ``"true"`` (as the reference)."""
    if impute_fit not in ("all", "train"):
        raise ValueError("impute_fit must be 'all' or 'train'")
    if sources is None:
        if raw_dir is None:
            raise ValueError("raw_dir or sources is required")
        sources = load_raw_tables(spark, raw_dir, unknown_bool=unknown_bool)
    root = (artifacts_root or f"{shared_dir(spark)}/runs").rstrip("/")
    st = RunState(run_id=run_id or new_run_id())
    clock = {"t": time.perf_counter()}
    stages: dict[str, float] = {}
    st.extra["stage_seconds"] = stages

    def lap(name: str) -> None:
        now = time.perf_counter()
        stages[name] = round(now - clock["t"], 3)
        clock["t"] = now

    st.run_dir = f"{root}/{st.run_id}"
    st.status, st.started_at = "INITIATED", _now()
    art.write_document(spark, {"run_id": st.run_id, "started_at": st.started_at},
                       STARTED_SCHEMA, f"{st.run_dir}/run_started")

    # ingest -> clean table (written once, then read back: lineage cut here)
    obs = Observation("ingest")
    clean_df = ing.ingest(sources, check_keys=True, observation=obs)
    st.clean_data_path = f"{st.run_dir}/clean_data"
    clean = write_series(clean_df, st.clean_data_path, csv_path=csv_path)
    m = obs.get
    st.rows_in, st.rows_dropped = m.get("rows_in"), m.get("rows_in", 0) - m.get("rows_out", 0)
    lap("ingest")

    # one (Store, Dept) window pass shared by the findings and the features;
    # persisted (memory and disk), recomputed from the clean table if lost,
    # released however the run ends
    lagged = feat.add_lags(clean).persist()
    try:
        # analyst stage: findings + contract
        st.extra["findings"] = analyse(spark, clean, st.run_dir, lagged)
        lap("findings")
        contract = contract or con.build_contract(
            clean, spark.read.parquet(st.extra["findings"]["contract_bounds"]))
        st.contract_path = f"{st.run_dir}/dataset_contract"
        art.write_contract(spark, contract, st.contract_path)
        st.status = "ANALYST_COMPLETE"

        # gate
        result = con.validate(clean, art.load_contract(spark, st.contract_path))
        st.contract_status, st.validation_errors, st.validation_warnings = (
            result.status, result.errors, result.warnings)
        art.write_validation(spark, result.as_dict(), f"{st.run_dir}/validation_result")
        lap("contract_gate")
        if result.status == "FAIL":
            st.status = "FAILED"
            st.finished_at = _now()
            art.write_run_metadata(spark, st.metadata(), f"{st.run_dir}/run_metadata")
            return st
        st.status = "VALIDATED"

        # scientist stage: features (written), train, select, artifacts
        features_path = f"{st.run_dir}/features"
        fit = None
        if impute_fit == "train":
            cutoff = mdl.cutoff_date(feat.modelled_dates(lagged))
            fit = clean.filter(F.col("Date") <= F.lit(cutoff))
            st.extra["impute_fit_cutoff"] = str(cutoff)
        art.write_table(feat.engineer_features(lagged, prelagged=True, fit=fit), features_path)
    finally:
        lagged.unpersist()
    ft = spark.read.parquet(features_path)
    lap("features")
    cols = feat.feature_columns(ft)
    res = mdl.train_and_select(ft, cols, num_trees=num_trees, max_depth=max_depth, max_bins=max_bins)
    lap("train_select")
    art.save_model(res.models[res.selected_model_name], f"{st.run_dir}/selected_model")
    art.write_evaluation_report(spark, res.report(), f"{st.run_dir}/evaluation_report")
    art.write_table(res.comparison(spark), f"{st.run_dir}/model_comparison")
    st.selected_model_name, st.candidate_metrics = res.selected_model_name, res.candidate_metrics
    st.status = "SCIENTIST_COMPLETE"

    st.status = "COMPLETED"
    st.finished_at = _now()
    art.write_run_metadata(spark, st.metadata(), f"{st.run_dir}/run_metadata")
    lap("artifacts")
    return st


def validate_paths(spark: SparkSession, data_path: str, contract_path: str) -> con.ValidationResult:
    """Validate a written clean table against a written contract (a Spark
    JSON document folder, or a plain ``.json`` file)."""
    contract = (art.load_contract_file(spark, contract_path) if contract_path.endswith(".json")
                else art.load_contract(spark, contract_path))
    return con.validate(read_clean(spark, data_path), contract)


def forecast(spark: SparkSession, run_dir: str) -> DataFrame:
    """Score the hold-out of a finished run with its saved model, mean per
    date, long form (the predictive dashboard's series)."""
    report = art.load_evaluation_report(spark, f"{run_dir}/evaluation_report")
    model = art.load_model(spark, f"{run_dir}/selected_model")
    if report is None or model is None:
        raise FileNotFoundError(f"no finished model in {run_dir}")
    ft = spark.read.parquet(f"{run_dir}/features")
    cutoff = F.to_date(F.lit(report["split_cutoff_date"]))
    test = mdl.split(ft, cutoff)[1]
    return mdl.forecast_by_date(model.transform(test))
