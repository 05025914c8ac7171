"""Chronological split, metrics and the two candidate models."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from salespanel.operators import features as feat
from salespanel.operators import model as mdl
from salespanel.sources import artifacts as art
from tests.conftest import CLEAN_DDL, d

# Fixed noise for the multi-series fixture (a literal list, not a random stream).
NOISE = [((i * 37) % 11 - 5) * 0.9 for i in range(120)]


def multi_series(spark, n_weeks=30):
    rows = []
    k = 0
    for store in (1, 2):
        for dept in (1, 2):
            base = 100.0 * store + 10.0 * dept
            for w in range(n_weeks):
                rows.append((store, dept, d("2010-01-01") + dt.timedelta(days=7 * w),
                             base + NOISE[k % len(NOISE)] + 1.5 * w, False, "A" if store == 1 else "B",
                             100000, 50.0, 3.0, None, None, None, None, None, 200.0, 8.0))
                k += 1
    return spark.createDataFrame(rows, CLEAN_DDL)


def hundred_dates(spark):
    rows = [(d("2010-01-01") + dt.timedelta(days=7 * i), float(i)) for i in range(100)]
    return spark.createDataFrame(rows, "Date date, Weekly_Sales double")


def test_chronological_split_boundary_is_strict(spark):
    df = hundred_dates(spark)
    train, test, cutoff = mdl.chrono_split(df, 0.8)
    assert cutoff == d("2010-01-01") + dt.timedelta(days=7 * 79)
    tmax = train.agg(F.max("Date")).first()[0]
    smin = test.agg(F.min("Date")).first()[0]
    assert tmax <= cutoff < smin
    assert train.count() + test.count() == 100
    assert 0.7 <= train.count() / 100 <= 0.85


def test_split_needs_two_dates(spark):
    df = spark.createDataFrame([(d("2010-01-01"), 1.0)], "Date date, Weekly_Sales double")
    with pytest.raises(mdl.SplitError):
        mdl.chrono_split(df)


def test_split_summary(spark):
    r = mdl.split_summary(hundred_dates(spark)).first()
    assert (r.n_dates, r.train_rows, r.test_rows) == (100, 80, 20)


def test_train_and_select_trains_both_and_selects_lowest_rmse(spark):
    df = feat.engineer_features(multi_series(spark))
    res = mdl.train_and_select(df, feat.feature_columns(df))
    assert set(res.candidate_metrics) == {"Ridge", "RandomForestRegressor"}
    for m in res.candidate_metrics.values():
        assert m["MAE"] >= 0 and m["RMSE"] >= 0 and math.isfinite(m["R2"])
    best = min(m["RMSE"] for m in res.candidate_metrics.values())
    assert res.candidate_metrics[res.selected_model_name]["RMSE"] == best
    assert res.train_rows > 0 and res.test_rows > 0
    cmp = res.comparison(spark).collect()
    assert sum(r.selected for r in cmp) == 1


def test_save_and_load_model(spark, tmp_path):
    df = feat.engineer_features(multi_series(spark))
    cols = feat.feature_columns(df)
    res = mdl.train_and_select(df, cols, num_trees=10, max_depth=4)
    path = str(tmp_path / "model")
    art.save_model(res.models[res.selected_model_name], path)
    art.write_evaluation_report(spark, res.report(), str(tmp_path / "report"))
    loaded = art.load_model(spark, path)
    assert loaded.transform(df.limit(3)).count() == 3
    rep = art.load_evaluation_report(spark, str(tmp_path / "report"))
    assert rep["selected_model_name"] == res.selected_model_name
    assert rep["feature_columns"] == cols
    assert art.load_model(spark, str(tmp_path / "nope")) is None


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(7)
    n, alpha = 400, 1000.0
    X = rng.normal(size=(n, 3)) * np.array([1.0, 50.0, 0.01]) + np.array([3.0, -20.0, 1.0])
    y = X @ np.array([2.0, -0.5, 300.0]) + rng.normal(scale=3.0, size=n) + 40.0
    rows = [(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(X, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, Weekly_Sales double")
    model = mdl.ridge_estimator(df, ["a", "b", "c"], alpha=alpha).fit(df)
    lr = model.stages[-1]
    Xc, yc = X - X.mean(0), y - y.mean()
    beta = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(3), Xc.T @ yc)
    icpt = y.mean() - X.mean(0) @ beta
    assert np.allclose(lr.coefficients.toArray(), beta, rtol=1e-8)
    assert abs(lr.intercept - icpt) < 1e-6 * max(1.0, abs(icpt))


def test_evaluate_metrics_and_constant_target(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "Weekly_Sales double, prediction double")
    r = mdl.evaluate(df).first()
    assert abs(r.MAE - 2.0 / 3) < 1e-12 and abs(r.RMSE - math.sqrt(2.0 / 3)) < 1e-12
    assert abs(r.R2 - (1 - 2.0 / 8)) < 1e-12
    c = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "Weekly_Sales double, prediction double")
    assert mdl.evaluate(c).first().R2 == 1.0
    c2 = spark.createDataFrame([(2.0, 1.0), (2.0, 2.0)], "Weekly_Sales double, prediction double")
    assert mdl.evaluate(c2).first().R2 == 0.0


def test_null_features_are_named(spark):
    df = multi_series(spark).withColumn("Size", F.lit(None).cast("int"))
    ft = feat.engineer_features(df)
    with pytest.raises(ValueError, match="Size"):
        mdl.train_and_select(ft, feat.feature_columns(ft))


def test_candidates_are_compared_on_scored_rows(spark):
    from salespanel.operators.model import compare_scored
    df = lambda *p: spark.createDataFrame([(float(i), x) for i, x in enumerate(p)], "Weekly_Sales double, prediction double")
    got = compare_scored({"a": df(1.0, 2.0), "b": df(0.0, 1.0), "c": df(0.0, 1.0)}).collect()
    assert {r.model: r.selected for r in got} == {"a": False, "b": True, "c": False}
    assert next(r.MAE for r in got if r.model == "a") == 1.0


def test_ridge_solves_its_moment_equations(spark):
    rng = np.random.default_rng(3)
    n, alpha, cols = 300, 50.0, ["a", "b", "c"]
    X = rng.normal(size=(n, 3)) * np.array([1.0, 500.0, 0.1]) + np.array([100.0, -20.0, 1.0])
    y = X @ np.array([2.0, -0.5, 30.0]) + rng.normal(size=n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([X, y])], "a double, b double, c double, Weekly_Sales double").repartition(7)
    got = {(r.col_a, r.col_b): r for r in mdl.ridge_moments(df, cols).collect()}
    assert len(got) == 10 and all(r.n == n for r in got.values())
    M = np.column_stack([X, y])
    names = [*cols, "Weekly_Sales"]
    centred = M - M.mean(0)
    for i, a in enumerate(names):
        for j, b in enumerate(names[i:], i):
            scale = np.sqrt((centred[:, i] ** 2).sum() * (centred[:, j] ** 2).sum())
            assert abs(got[a, b].comoment - centred[:, i] @ centred[:, j]) <= 1e-11 * scale
            assert np.isclose(got[a, b].mean_a, M[:, i].mean(), rtol=1e-13, atol=0)
    of = lambda a, b: got[(a, b) if (a, b) in got else (b, a)].comoment
    C = np.array([[of(a, b) for b in cols] for a in cols]) + alpha * np.eye(3)
    c = np.array([of(a, "Weekly_Sales") for a in cols])
    lr = mdl.ridge_estimator(df, cols, alpha=alpha).fit(df).stages[-1]
    beta = lr.coefficients.toArray()
    assert np.allclose(C @ beta, c, rtol=1e-7)
    assert np.isclose(lr.intercept, y.mean() - X.mean(0) @ beta, rtol=1e-9)


def test_moments_merge_and_wide_matrices_stay_in_groups(spark):
    from salespanel.operators.moments import FIELDS, in_groups, moments
    cols = [f"x{i}" for i in range(25)]
    df = spark.range(200).select(*[F.sin(F.col("id") * (i + 1)).alias(c) for i, c in enumerate(cols)])
    assert moments(df, cols).count() == 25 * 26 // 2
    groups = in_groups([(a, b) for i, a in enumerate(cols) for b in cols[i:]], lambda p: 3 if p[0] == p[1] else 10)
    assert sum(map(len, groups)) == 325
    assert all(sum(3 if a == b else 10 for a, b in g) <= FIELDS for g in groups)


def exact_tree(X, y, depth):
    """Plain regression tree over every split half-way between two values."""
    best = None
    for j in range(X.shape[1]):
        v = np.unique(X[:, j])
        for cut in (v[:-1] + v[1:]) / 2 if len(v) > 1 else []:
            left = X[:, j] < cut
            sse = sum(((y[s] - y[s].mean()) ** 2).sum() for s in (left, ~left))
            if best is None or sse < best[0] - 1e-9:
                best = (sse, j, cut)
    if depth == 0 or best is None or best[0] >= ((y - y.mean()) ** 2).sum() - 1e-12:
        return lambda x: y.mean()
    _, j, cut = best
    left = X[:, j] < cut
    a, b = exact_tree(X[left], y[left], depth - 1), exact_tree(X[~left], y[~left], depth - 1)
    return lambda x: a(x) if x[j] < cut else b(x)


def test_forest_of_one_tree_is_the_exact_tree(spark):
    rng = np.random.default_rng(4)
    X = np.column_stack([rng.integers(0, 40, 500), rng.normal(size=500).round(2), np.full(500, 7.0), rng.integers(0, 2, 500)]).astype(float)
    y = np.where(X[:, 0] > 23, 5.0, 1.0) * X[:, 1] + X[:, 3] * 2 + rng.normal(size=500) * 0.01
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([X, y])], ", ".join(f"{c} double" for c in [*names, "Weekly_Sales"]))
    cuts = mdl.split_candidates(df, names, 1000)
    assert cuts["c"] == [] and cuts["d"] == [0.5]
    v = np.unique(X[:, 1])
    assert np.allclose(cuts["b"], (v[:-1] + v[1:]) / 2)
    model = mdl.forest_estimator(names, cuts, 500, num_trees=1, max_depth=3, bootstrap=False).fit(df)
    want = exact_tree(X, y, 3)
    got = model.transform(df).select(*names, "prediction").collect()
    assert np.allclose([r.prediction for r in got], [want(np.array(r[:4])) for r in got])


def test_split_candidates_do_not_depend_on_partitions_or_runs(spark):
    n, bins = 20_000, 64
    df = spark.range(n).select((F.pmod(F.xxhash64("id"), F.lit(9973)) * 0.37).alias("a"), (F.col("id") % 50).alias("b"),
                               F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id") / 7).alias("c"))
    first = mdl.split_candidates(df.repartition(3), ["a", "b", "c"], bins)
    assert first == mdl.split_candidates(df.repartition(11), ["a", "b", "c"], bins)
    values = np.sort(np.array([r.a for r in df.select("a").collect()]))
    want = np.unique(values[[n * k // bins for k in range(bins)]])
    assert first["a"] == [x for x in want.tolist() if x > want[0]]
    assert first["b"] == [k + 0.5 for k in range(49)]
    assert 0.0 not in first["c"] and len(first["c"]) < bins
