"""Chronological split, evaluation metrics and the two candidate models
(ridge, random forest) with lowest-RMSE selection, on Spark ML.

The split is one global date cutoff (no random split). Metrics are one SQL
aggregation over the scored hold-out. Models are ``Pipeline([VectorAssembler,
estimator])`` so the fitted artifact scores raw feature tables directly.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salespanel.functions.scalar import exact_mean
from salespanel.operators.moments import moments
from salespanel.operators.quantiles import evenly_spaced, stored, value_counts, values_at_ranks
from salespanel.schemas import TARGET, TRAIN_FRACTION

# Candidate names and their hyper-parameters.
RIDGE = "Ridge"
FOREST = "RandomForestRegressor"
CANDIDATES = (RIDGE, FOREST)
RIDGE_ALPHA = 1.0
FOREST_TREES = 100
FOREST_SEED = 42
# Spark caps tree depth at 30 and an unlimited-depth forest is not
# reproducible; depth 10 keeps the fit bounded (see README).
FOREST_MAX_DEPTH = 10
# A feature with at most so many values is cut between all of them, others at so many exact quantiles.
FOREST_MAX_BINS = 64


class SplitError(ValueError):
    """Raised when the data cannot be split chronologically."""


# ---- split -----------------------------------------------------------------
def chrono_cutoff(df: DataFrame, date_col: str = "Date", train_fraction: float = TRAIN_FRACTION) -> DataFrame:
    """One row (n_dates, cutoff_index, cutoff_date): with n sorted distinct
    dates, index = max(0, min(n - 2, int(n * f) - 1)); the cutoff date is
    null when there are fewer than 2 dates.

    The date at that rank is found by the rank selection of ``quantiles``, so
    the distinct dates are never gathered in one task or on the driver."""
    dates = df.select(F.col(date_col).alias("d")).distinct()

    def idx(n):
        return F.greatest(F.lit(0), F.least(n.cast("int") - 2,
                                            F.floor(n * F.lit(float(train_fraction))).cast("int") - 1))

    sel = values_at_ranks(dates, "d", {"cutoff_date": idx})
    return sel.select(F.col("n").cast("long").alias("n_dates"), idx(F.col("n")).alias("cutoff_index"),
                      F.when(F.col("n") >= 2, F.col("cutoff_date")).alias("cutoff_date"))


def cutoff_date(df: DataFrame, date_col: str = "Date", train_fraction: float = TRAIN_FRACTION):
    """The cutoff as a driver scalar (one value); raises with < 2 dates."""
    r = chrono_cutoff(df, date_col, train_fraction).first()
    if r is None or r["n_dates"] < 2 or r["cutoff_date"] is None:
        raise SplitError("Not enough distinct dates to perform a chronological split")
    return r["cutoff_date"]


def split(df: DataFrame, cutoff, date_col: str = "Date") -> tuple[DataFrame, DataFrame]:
    """train = Date <= cutoff, test = Date > cutoff (filters on a literal, so
    they push down to a date-partitioned or sorted source)."""
    c = F.lit(cutoff)
    return df.filter(F.col(date_col) <= c), df.filter(F.col(date_col) > c)


def chrono_split(df: DataFrame, train_fraction: float = TRAIN_FRACTION, date_col: str = "Date"):
    """(train, test, cutoff); an empty side is an error."""
    cutoff = cutoff_date(df, date_col, train_fraction)
    train, test = split(df, cutoff, date_col)
    counts = split_counts(df, cutoff, date_col).first()
    if counts["train_rows"] == 0 or counts["test_rows"] == 0:
        raise SplitError("Chronological split produced an empty train or test partition")
    return train, test, cutoff


def split_counts(df: DataFrame, cutoff, date_col: str = "Date") -> DataFrame:
    c = F.lit(cutoff)
    return df.agg(F.count_if(F.col(date_col) <= c).alias("train_rows"),
                  F.count_if(F.col(date_col) > c).alias("test_rows"))


def split_summary(df: DataFrame, train_fraction: float = TRAIN_FRACTION, date_col: str = "Date") -> DataFrame:
    """One row: n_dates, cutoff_date, train_rows, test_rows (lazy: the cutoff
    is a scalar subquery, computed once)."""
    cut = chrono_cutoff(df, date_col, train_fraction).select(
        F.struct("n_dates", "cutoff_date").alias("c")).scalar()
    flagged = df.select((F.col(date_col) <= cut["cutoff_date"]).alias("__train"),
                        (F.col(date_col) > cut["cutoff_date"]).alias("__test"))
    return (flagged.agg(F.count_if("__train").alias("train_rows"), F.count_if("__test").alias("test_rows"))
                   .select(cut["n_dates"].alias("n_dates"), cut["cutoff_date"].alias("cutoff_date"),
                           "train_rows", "test_rows"))


def label_split(df: DataFrame, train_fraction: float = TRAIN_FRACTION, date_col: str = "Date") -> DataFrame:
    """Every row with is_train (Date <= cutoff), lazily (the cutoff is a
    scalar subquery)."""
    cut = chrono_cutoff(df, date_col, train_fraction).select("cutoff_date").scalar()
    return df.withColumn("is_train", F.col(date_col) <= cut)


# ---- metrics ---------------------------------------------------------------
def evaluate(scored: DataFrame, label: str = TARGET, prediction: str = "prediction",
             digits: int | None = None) -> DataFrame:
    """One row: MAE, RMSE, R2 (scikit-learn definitions; a constant target
    gives R2 = 1.0 for a perfect fit, else 0.0). One aggregation pass: the
    total sum of squares is n * var_pop(y), whose partial aggregates merge
    in a numerically stable way."""
    y, p = F.col(label), F.col(prediction)
    e = y - p
    agg = scored.agg(F.avg(F.abs(e)).alias("MAE"),
                     F.sqrt(F.avg(e * e)).alias("RMSE"),
                     F.sum(e * e).alias("__sse"),
                     (F.var_pop(y) * F.count(y)).alias("__sst"))
    r2 = (F.when(F.col("__sst") == 0, F.when(F.col("__sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(F.lit(1.0) - F.col("__sse") / F.col("__sst")))
    out = agg.select("MAE", "RMSE", r2.alias("R2"))
    if digits is not None:
        out = out.select(*[F.round(c, digits).alias(c) for c in ("MAE", "RMSE", "R2")])
    return out


# ---- models ----------------------------------------------------------------
def check_no_nulls(df: DataFrame, cols: list[str]) -> None:
    """Fail early, naming the feature columns that hold nulls."""
    r = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    bad = [c for c in cols if r[c]]
    if bad:
        raise ValueError(f"feature columns contain nulls: {bad}")


def ridge_estimator(train: DataFrame, feature_cols: list[str], label: str = TARGET,
                    alpha: float = RIDGE_ALPHA) -> Pipeline:
    """Ridge (L2, intercept, unscaled inputs). Spark's penalty is scaled by
    the label's population std and the row count: regParam = alpha * std / n
    with the normal-equation solver gives the closed-form ridge solution."""
    st = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("sd")).first()
    n, sd = int(st["n"]), float(st["sd"] or 0.0)
    reg = alpha * sd / n if n and sd > 0 else 0.0
    lr = LinearRegression(featuresCol="__features", labelCol=label, predictionCol="prediction",
                          regParam=reg, elasticNetParam=0.0, standardization=False,
                          solver="normal", fitIntercept=True)
    return Pipeline(stages=[VectorAssembler(inputCols=feature_cols, outputCol="__features"), lr])


def ridge_moments(train: DataFrame, feature_cols: list[str], label: str = TARGET) -> DataFrame:
    """The centred moment matrix of the features and the label: all that the
    ridge solution depends on. With C the features' comoments, c those with
    the label, the coefficients solve (C + alpha * I) b = c, and the intercept is
    the label's mean less that of the features weighted by b."""
    return moments(train, [*feature_cols, label])


def split_candidates(train: DataFrame, feature_cols: list[str], max_bins: int = FOREST_MAX_BINS) -> dict[str, list[float]]:
    """Where each feature may be cut, from all rows: half-way between every
    two neighbouring values of a feature with at most ``max_bins`` of them,
    else at the exact values that stand at every ``max_bins``-th of the rows.
    The same on every run and however the rows are partitioned.

    One pass counts the values of all features; at most ``max_bins`` numbers
    a feature come to the driver."""
    cuts: dict[str, list[float]] = {c: [] for c in feature_cols}
    numbers = [c for c in feature_cols if isinstance(train.schema[c].dataType, T.NumericType)]  # a vector of 0 and 1 needs none
    if not numbers:
        return cuts
    stacked = train.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in numbers])))
    counts, _ = stored(value_counts(stacked, "value", ["column"]), "split-values")
    sizes = {r["column"]: r["count"] for r in counts.groupBy("column").count().collect()}  # a row a feature
    few = [c for c, k in sizes.items() if k <= max_bins]
    many = [c for c, k in sizes.items() if k > max_bins]
    if few:
        for r in counts.filter(F.col("column").isin(few)).groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("v")).collect():
            cuts[r["column"]] = [a + (b - a) / 2 for a, b in zip(r["v"], r["v"][1:])]
    if many:
        at = evenly_spaced(counts.filter(F.col("column").isin(many)), "value", max_bins, ["column"], max(sizes[c] for c in many))
        for r in at.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("v")).collect():
            cuts[r["column"]] = r["v"][1:]  # nothing lies below the least value
    return cuts


def forest_estimator(feature_cols: list[str], cuts: dict[str, list[float]], n_rows: int, label: str = TARGET,
                     num_trees: int = FOREST_TREES, max_depth: int = FOREST_MAX_DEPTH, seed: int = FOREST_SEED,
                     bootstrap: bool = True) -> Pipeline:
    """Random forest: bootstrap rows, every feature considered at each split
    and at each of its ``cuts`` (``split_candidates``): the features are cut
    first, and trees split the numbers of their intervals.

    Spark looks for split points among max(10,000, maxBins^2) sampled rows and
    takes all it finds if they are fewer than maxBins; with maxBins^2 above
    ``n_rows`` the sample is every row, so no interval is missed.
    Node ids are cached between levels (fewer passes, same model); their
    lineage is checkpointed to the session's checkpoint directory."""
    cut = [c for c in feature_cols if cuts[c]]
    stages = []
    if cut:
        # an interval's number is marked as a category; a sum is plain and ordered again
        plain = ", ".join(f"`__in_{c}` + 0D AS `__cut_{c}`" for c in cut)
        stages = [Bucketizer(splitsArray=[[float("-inf"), *cuts[c], float("inf")] for c in cut], inputCols=cut,
                             outputCols=[f"__in_{c}" for c in cut]),
                  SQLTransformer(statement=f"SELECT * EXCEPT ({', '.join(f'`__in_{c}`' for c in cut)}), {plain} FROM __THIS__")]
    max_bins = max(math.isqrt(max(0, n_rows)) + 2, *[len(v) + 2 for v in cuts.values()], 2)
    rf = RandomForestRegressor(featuresCol="__features", labelCol=label, predictionCol="prediction",
                               numTrees=num_trees, maxDepth=max_depth, maxBins=max_bins, seed=seed,
                               featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=bootstrap,
                               cacheNodeIds=True, checkpointInterval=10)
    inputs = [f"__cut_{c}" if cuts[c] else c for c in feature_cols]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="__features"), rf])


@dataclass
class TrainingResult:
    selected_model_name: str
    models: dict[str, PipelineModel]
    candidate_metrics: dict[str, dict[str, float]]
    feature_columns: list[str]
    target_column: str
    train_rows: int
    test_rows: int
    split_cutoff_date: str
    extra: dict[str, Any] = field(default_factory=dict)

    def report(self) -> dict[str, Any]:
        return {"selected_model_name": self.selected_model_name,
                "candidate_metrics": self.candidate_metrics,
                "feature_columns": list(self.feature_columns),
                "target_column": self.target_column,
                "train_rows": self.train_rows, "test_rows": self.test_rows,
                "split_cutoff_date": self.split_cutoff_date}

    def comparison(self, spark) -> DataFrame:
        rows = [(m, v["MAE"], v["RMSE"], v["R2"], m == self.selected_model_name)
                for m, v in self.candidate_metrics.items()]
        return spark.createDataFrame(rows, "model string, MAE double, RMSE double, R2 double, selected boolean")


def train_and_select(df: DataFrame, feature_cols: list[str], label: str = TARGET,
                     train_fraction: float = TRAIN_FRACTION, num_trees: int = FOREST_TREES,
                     max_depth: int = FOREST_MAX_DEPTH, max_bins: int = FOREST_MAX_BINS,
                     candidates=CANDIDATES) -> TrainingResult:
    """Fit every candidate on the rows up to the cutoff, score the rows
    after it, and select the lowest RMSE (first candidate wins ties)."""
    train, test, cutoff = chrono_split(df, train_fraction)
    check_no_nulls(train, feature_cols)
    train = train.select(*feature_cols, label).persist()
    test = test.select("Date", *feature_cols, label).persist()
    try:
        n_train, n_test = train.count(), test.count()

        def fit_and_score(name: str):
            est = (ridge_estimator(train, feature_cols, label) if name == RIDGE
                   else forest_estimator(feature_cols, split_candidates(train, feature_cols, max_bins), n_train, label, num_trees, max_depth))
            model = est.fit(train)
            m = evaluate(model.transform(test), label).first()
            return name, model, {"MAE": float(m["MAE"]), "RMSE": float(m["RMSE"]), "R2": float(m["R2"])}

        # the candidates are independent jobs: fit them concurrently
        with ThreadPoolExecutor(max_workers=len(candidates)) as pool:
            done = list(pool.map(fit_and_score, candidates))
        models = {n: mo for n, mo, _ in done}
        metrics = {n: me for n, _, me in done}
    finally:
        train.unpersist()
        test.unpersist()
    best = min(candidates, key=lambda k: (metrics[k]["RMSE"], candidates.index(k)))
    return TrainingResult(best, models, metrics, list(feature_cols), label, n_train, n_test, str(cutoff))


def compare_scored(scored: dict[str, DataFrame], label: str = TARGET) -> DataFrame:
    """One row per candidate (model, MAE, RMSE, R2, selected), aggregated from
    its scored rows; the lowest RMSE is selected, the first candidate of a tie."""
    rows = None
    for i, (name, df) in enumerate(scored.items()):
        r = evaluate(df, label).select(F.lit(name).alias("model"), "MAE", "RMSE", "R2", F.lit(i).alias("__at"))
        rows = r if rows is None else rows.unionByName(r)
    # one row per candidate: the whole list fits one row
    each = rows.agg(F.collect_list(F.struct("RMSE", "__at", "model", "MAE", "R2")).alias("r"))
    each = each.select(F.explode(F.array_sort("r")).alias("c"), F.array_min("r")["__at"].alias("best"))
    return each.select("c.model", "c.MAE", "c.RMSE", "c.R2", (F.col("c.__at") == F.col("best")).alias("selected"))


def forecast_by_date(scored: DataFrame, label: str = TARGET, prediction: str = "prediction",
                     prediction_name: str = "Predicted_Sales", exact_prediction: bool = False) -> DataFrame:
    """Mean actual and predicted sales per date, long form (Date, Series, Sales).
    ``exact_prediction`` sums the prediction in DECIMAL too (for a prediction
    that is itself a sales measure, like a lag)."""
    pred_mean = exact_mean(prediction) if exact_prediction else F.avg(prediction)
    per_date = scored.groupBy("Date").agg(exact_mean(label).alias(label),
                                          pred_mean.alias(prediction_name))
    return per_date.unpivot(["Date"], [label, prediction_name], "Series", "Sales")
