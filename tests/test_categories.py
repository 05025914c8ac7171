"""One-hot vectors of many categories."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from salespanel.operators.categories import encode_sparse, fit_categories

TYPES = 5000


@pytest.fixture(scope="module")
def many(spark):
    df = spark.range(TYPES * 3).select("id", F.when(F.col("id") % 100 != 99, F.concat(F.lit("t"), (F.pmod(F.xxhash64("id"), F.lit(10 ** 12)) * 0 + F.pmod(
        F.col("id") * 7, F.lit(TYPES))).cast("string"))).alias("Type"), (F.col("id") % 13).cast("double").alias("y"))
    return df.repartition(7)


def test_thousands_of_types(spark, many):
    fitted = fit_categories(many)
    values = sorted(r.Type for r in many.select("Type").dropna().distinct().collect())
    assert fitted.size == len(values) > 1000
    assert {r.value: r["index"] for r in fitted.table.collect()} == {v: i for i, v in enumerate(values)}
    at = {v: i for i, v in enumerate(values)}
    got = encode_sparse(many, fitted)
    assert got.columns == ["id", "y", "Type_vector"]
    vectors = {r.id: r.Type_vector for r in got.collect()}
    assert len(vectors) == TYPES * 3
    for r in many.collect():
        v = vectors[r.id]
        assert v.size == fitted.size and type(v).__name__ == "SparseVector"
        assert (v.indices.tolist(), v.values.tolist()) == (([at[r.Type]], [1.0]) if r.Type else ([], []))


def test_no_job_runs_while_the_plan_is_built(spark, many):
    fitted = fit_categories(many)
    sc = spark.sparkContext
    sc.setJobGroup("encode-only", "categories")
    try:
        out = encode_sparse(many, fitted)
        assert not sc.statusTracker().getJobIdsForGroup("encode-only")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == TYPES * 3


def test_unseen_and_empty(spark, many):
    fitted = fit_categories(spark.createDataFrame([("b",), ("a",), (None,)], "Type string"))
    got = {r.k: r.v for r in encode_sparse(spark.createDataFrame([(1, "a"), (2, "b"), (3, "new"), (4, None)], "k int, Type string"), fitted, "v").collect()}
    assert {k: v.toArray().tolist() for k, v in got.items()} == {1: [1, 0], 2: [0, 1], 3: [0, 0], 4: [0, 0]}
    none = fit_categories(spark.createDataFrame([(None,)], "Type string"))
    assert none.size == 0 and encode_sparse(many, none).columns == ["id", "y"]


def test_vectors_feed_a_model(spark, many):
    fitted = fit_categories(many.filter("id < 300"))
    data = VectorAssembler(inputCols=["Type_vector"], outputCol="features").transform(encode_sparse(many.filter("id < 300"), fitted))
    model = LinearRegression(labelCol="y", regParam=0.1, elasticNetParam=0.0, maxIter=5, solver="l-bfgs").fit(data)
    assert model.numFeatures == fitted.size and model.transform(data).count() == 300


def test_features_and_models_take_the_vector(spark):
    from salespanel.operators import features as feat
    from salespanel.operators import model as mdl
    from tests.test_model import multi_series
    df = multi_series(spark)
    ft = feat.engineer_features(df, categories=fit_categories(df))
    cols = feat.feature_columns(ft)
    assert "Type_vector" in cols and not any(c.startswith("Type_A") for c in cols)
    res = mdl.train_and_select(ft, cols, num_trees=5, max_depth=3)
    wide = feat.engineer_features(df)
    same = mdl.train_and_select(wide, feat.feature_columns(wide), num_trees=5, max_depth=3)
    assert res.candidate_metrics["Ridge"]["RMSE"] == pytest.approx(same.candidate_metrics["Ridge"]["RMSE"], rel=1e-6)
