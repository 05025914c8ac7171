"""DuckDB oracle SQL for every registered query.

The oracle is an independent formulation of the same result: the clean panel
is the plain SQL of the derived panel (tables ``lineitem orders supplier
customer nation`` are views), and each query restates the operator in SQL.
Measures are summed in DECIMAL and per-row arithmetic is written exactly as
the Spark side evaluates it, so results agree bit for bit; values that come
out of floating aggregates (standard deviation, correlation, quantiles,
medians, model metrics) are rounded to 6 places on both sides.
"""

from __future__ import annotations

CLEAN_CTES = """
lines AS (
  SELECT s_nationkey AS Store, l_linenumber AS Dept,
         CAST(date_trunc('week', l_shipdate) AS DATE) AS Date,
         o_orderpriority AS pr, l_quantity, l_returnflag,
         CAST(l_tax AS DECIMAL(4,2)) AS tax,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(l_discount AS DECIMAL(3,2)) AS disc
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
                JOIN orders   ON l_orderkey = o_orderkey),
train AS (
  SELECT Store, Dept, Date,
         CAST(SUM(price * (CAST(1 AS DECIMAL(3,2)) - disc)
              * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS DOUBLE) AS Weekly_Sales,
         weekofyear(Date) IN (6, 36, 47, 52) AS IsHoliday
  FROM lines GROUP BY Store, Dept, Date),
stores AS (
  SELECT n_nationkey AS Store,
         CASE n_regionkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS Type,
         CAST(COUNT(*) * 1000 + n_nationkey AS INT) AS Size
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  GROUP BY n_nationkey, n_regionkey),
wk AS (
  SELECT Store, Date, SUM(l_quantity) / COUNT(*) AS Temperature,
         CAST(SUM(tax) AS DOUBLE) / COUNT(*) AS Fuel_Price,
         CAST(SUM(CASE WHEN pr LIKE '1%' THEN price * disc END) AS DOUBLE) AS MarkDown1,
         CAST(SUM(CASE WHEN pr LIKE '2%' THEN price * disc END) AS DOUBLE) AS MarkDown2,
         CAST(SUM(CASE WHEN pr LIKE '3%' THEN price * disc END) AS DOUBLE) AS MarkDown3,
         CAST(SUM(CASE WHEN pr LIKE '4%' THEN price * disc END) AS DOUBLE) AS MarkDown4,
         CAST(SUM(CASE WHEN pr LIKE '5%' THEN price * disc END) AS DOUBLE) AS MarkDown5
  FROM lines GROUP BY Store, Date),
eco AS (
  SELECT c_nationkey AS Store, CAST(date_trunc('week', o_orderdate) AS DATE) AS Date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) / COUNT(*) AS CPI,
         CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(c_acctbal AS DECIMAL(12,2)) END) AS DOUBLE)
           / NULLIF(COUNT(CASE WHEN o_orderstatus = 'F' THEN 1 END), 0) AS Unemployment
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
clean AS (
  SELECT t.Store, t.Dept, t.Date, t.Weekly_Sales, t.IsHoliday, s.Type, s.Size,
         w.Temperature, w.Fuel_Price, w.MarkDown1, w.MarkDown2, w.MarkDown3, w.MarkDown4,
         w.MarkDown5, e.CPI, e.Unemployment
  FROM train t LEFT JOIN stores s ON t.Store = s.Store
               LEFT JOIN wk w  ON t.Store = w.Store AND t.Date = w.Date
               LEFT JOIN eco e ON t.Store = e.Store AND t.Date = e.Date)"""

# Exact mean of a sales measure: DECIMAL sum, cast once, divided by the count.
def mean_sql(expr: str) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE) / COUNT({expr})"


def sum_sql(expr: str) -> str:
    return f"CAST(SUM(CAST({expr} AS DECIMAL(18,4))) AS DOUBLE)"


def with_clean(body: str, extra_ctes: str = "") -> str:
    ctes = CLEAN_CTES + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{body}"


ORACLES: dict[str, str] = {}


def oracle(name: str):
    def reg(fn):
        ORACLES[name] = fn()
        return fn
    return reg


@oracle("monthly_trend")
def _():
    return with_clean(f"""SELECT strftime(Date, '%Y-%m') AS Month, {mean_sql('Weekly_Sales')} AS mean_sales
FROM clean GROUP BY 1 ORDER BY 1""")


MD = ("MarkDown1", "MarkDown2", "MarkDown3", "MarkDown4", "MarkDown5")
CLEAN_COLS = ("Store", "Dept", "Date", "Weekly_Sales", "IsHoliday", "Type", "Size",
              "Temperature", "Fuel_Price", *MD, "CPI", "Unemployment")


@oracle("profile_summary")
def _():
    return with_clean("""SELECT COUNT(*) AS row_count, 16 AS column_count, MIN(Date) AS min_date,
       MAX(Date) AS max_date, COUNT(DISTINCT Store) AS store_count, COUNT(DISTINCT Dept) AS dept_count
FROM clean""")


@oracle("null_profile")
def _():
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS null_count, COUNT(*) AS n FROM clean"
        for c in CLEAN_COLS)
    return with_clean(f"""SELECT column_name, null_count,
       round(CAST(null_count AS DOUBLE) / greatest(n, 1) * 100.0, 3) AS null_pct
FROM ({parts}) WHERE null_count > 0""")


@oracle("dept_top10")
def _():
    return with_clean("""SELECT Dept, COUNT(*) AS n_rows FROM clean GROUP BY Dept
ORDER BY n_rows DESC, Dept LIMIT 10""")


@oracle("sales_sign_counts")
def _():
    return with_clean("""SELECT CAST(count_if(Weekly_Sales = 0) AS BIGINT) AS zero_count,
       CAST(count_if(Weekly_Sales < 0) AS BIGINT) AS negative_count FROM clean""")


@oracle("zero_sales")
def _():
    return with_clean("""SELECT Store, Dept, Date, Weekly_Sales FROM clean WHERE Weekly_Sales = 0
ORDER BY Store, Dept, Date LIMIT 15""")


@oracle("negative_sales")
def _():
    return with_clean("""SELECT Store, Dept, Date, Weekly_Sales FROM clean WHERE Weekly_Sales < 0
ORDER BY Weekly_Sales, Store, Dept, Date LIMIT 15""")


HOLIDAY_MEANS = f"""hm AS (
  SELECT Store,
         {mean_sql('CASE WHEN IsHoliday THEN Weekly_Sales END')} AS holiday_mean,
         {mean_sql('CASE WHEN NOT IsHoliday THEN Weekly_Sales END')} AS non_holiday_mean
  FROM clean GROUP BY Store)"""


@oracle("holiday_spikes")
def _():
    return with_clean("""SELECT * FROM (
  SELECT Store, holiday_mean, non_holiday_mean, holiday_mean / NULLIF(non_holiday_mean, 0) AS spike_ratio
  FROM hm WHERE holiday_mean IS NOT NULL AND non_holiday_mean IS NOT NULL)
WHERE spike_ratio IS NOT NULL ORDER BY spike_ratio DESC, Store LIMIT 10""", HOLIDAY_MEANS)


IQR_BOUNDS = "bounds AS (SELECT md_column, q1, q3, q3 - q1 AS iqr, q3 + 3 * (q3 - q1) AS upper_fence FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS col_idx, '{c}' AS md_column, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM clean"
    for i, c in enumerate(MD)) + ") WHERE q1 IS NOT NULL)"


@oracle("markdown_iqr_bounds")
def _():
    return with_clean("SELECT md_column, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, "
                      "round(upper_fence, 6) AS upper_fence FROM bounds", IQR_BOUNDS)


OUTLIERS = "outl AS (SELECT md_column, Store, Dept, Date, value, round(fence, 2) AS upper_bound, CAST(rn AS INTEGER) AS rank_in_column, col_idx FROM (SELECT *, row_number() OVER (PARTITION BY col_idx ORDER BY value DESC, Store, Dept, Date) AS rn FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS col_idx, '{c}' AS md_column, Store, Dept, Date, {c} AS value, b.upper_fence AS fence FROM clean, bounds b WHERE b.md_column = '{c}' AND {c} > b.upper_fence"
    for i, c in enumerate(MD)) + ")) WHERE rn <= 5 ORDER BY col_idx, rn LIMIT 15)"


@oracle("markdown_outliers")
def _():
    return with_clean("SELECT md_column, Store, Dept, Date, value, upper_bound, rank_in_column FROM outl",
                      IQR_BOUNDS + "," + OUTLIERS)


PCT = """CASE WHEN prev_sales IS NULL OR Weekly_Sales IS NULL THEN NULL
     WHEN prev_sales = 0 AND Weekly_Sales > 0 THEN CAST('inf' AS DOUBLE)
     WHEN prev_sales = 0 AND Weekly_Sales < 0 THEN CAST('-inf' AS DOUBLE)
     WHEN prev_sales = 0 THEN NULL
     ELSE (Weekly_Sales - prev_sales) / abs(prev_sales) END"""
WOW = f"""wow AS (SELECT Store, Dept, Date, prev_sales, Weekly_Sales, {PCT} AS pct_change
  FROM (SELECT *, lag(Weekly_Sales) OVER (PARTITION BY Store, Dept ORDER BY Date) AS prev_sales FROM clean))"""


@oracle("wow_change")
def _():
    return with_clean("SELECT * FROM wow", WOW)


@oracle("wow_anomalies")
def _():
    return with_clean("""SELECT * FROM wow WHERE pct_change IS NOT NULL
ORDER BY abs(pct_change) DESC, Store, Dept, Date LIMIT 15""", WOW)


MONTHLY = f"mt AS (SELECT strftime(Date, '%Y-%m') AS Month, {mean_sql('Weekly_Sales')} AS mean_sales FROM clean GROUP BY 1)"


@oracle("trend_ends")
def _():
    return with_clean("""SELECT min(Month) AS first_month, arg_min(mean_sales, Month) AS first_mean,
       max(Month) AS last_month, arg_max(mean_sales, Month) AS last_mean FROM mt""", MONTHLY)


@oracle("holiday_impact")
def _():
    return with_clean(f"""SELECT {mean_sql('CASE WHEN IsHoliday THEN Weekly_Sales END')} AS holiday_mean,
       {mean_sql('CASE WHEN NOT IsHoliday THEN Weekly_Sales END')} AS non_holiday_mean FROM clean""")


@oracle("kpis")
def _():
    return with_clean(f"""SELECT {sum_sql('Weekly_Sales')} AS total_sales, {mean_sql('Weekly_Sales')} AS mean_sales,
       COUNT(DISTINCT Store) AS stores, COUNT(DISTINCT Dept) AS departments FROM clean""")


ANY_MD = " OR ".join(f"{c} IS NOT NULL" for c in MD)


@oracle("markdown_effect")
def _():
    return with_clean(f"""SELECT {mean_sql(f'CASE WHEN {ANY_MD} THEN Weekly_Sales END')} AS mean_with_markdown,
       {mean_sql(f'CASE WHEN NOT ({ANY_MD}) THEN Weekly_Sales END')} AS mean_without_markdown,
       (SELECT COUNT(*) FROM outl) AS extreme_outlier_count,
       (SELECT COUNT(*) FROM clean, (SELECT """ + ", ".join(
        f"max(CASE WHEN md_column = '{c}' THEN upper_fence END) AS f{i}" for i, c in enumerate(MD)) + """ FROM bounds) fz
        WHERE """ + " OR ".join(f"{c} > f{i}" for i, c in enumerate(MD)) + """) AS rows_above_fence
FROM clean""", IQR_BOUNDS + "," + OUTLIERS)


def _pearson(a: str, b: str) -> str:
    both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
    a2, b2 = f"CASE WHEN {both} THEN {a} END", f"CASE WHEN {both} THEN {b} END"
    return (f"round(covar_pop({a2}, {b2}) / NULLIF(sqrt(var_pop({a2}) * var_pop({b2})), 0), 6)")


@oracle("markdown_corr")
def _():
    cols = (*MD, "Weekly_Sales")
    parts = " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {_pearson(a, b)} AS corr FROM clean"
        for a in cols for b in cols)
    return with_clean(parts)


LAGGED = """lagged AS (SELECT *, lag(Weekly_Sales, 1) OVER w AS l1, lag(Weekly_Sales, 2) OVER w AS l2,
       lag(Weekly_Sales, 3) OVER w AS l3, lag(Weekly_Sales, 4) OVER w AS l4
  FROM clean WINDOW w AS (PARTITION BY Store, Dept ORDER BY Date)),
rolled AS (SELECT *, (l4 + l3 + l2 + l1) / CAST(4 AS DOUBLE) AS rm FROM lagged),
rolled2 AS (SELECT *,
       CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL AND l4 IS NOT NULL THEN rm END
         AS Weekly_Sales_RollingMean4,
       CASE WHEN l1 IS NOT NULL AND l2 IS NOT NULL AND l3 IS NOT NULL AND l4 IS NOT NULL
         THEN sqrt(((l4 - rm) * (l4 - rm) + (l3 - rm) * (l3 - rm) + (l2 - rm) * (l2 - rm)
                    + (l1 - rm) * (l1 - rm)) / CAST(3 AS DOUBLE)) END AS Weekly_Sales_RollingStd4
  FROM rolled)"""


@oracle("lag_features")
def _():
    return with_clean("""SELECT Store, Dept, Date, Weekly_Sales, l1 AS Weekly_Sales_Lag1, l4 AS Weekly_Sales_Lag4
FROM lagged""", LAGGED)


@oracle("rolling_features")
def _():
    return with_clean("SELECT Store, Dept, Date, Weekly_Sales_RollingMean4, Weekly_Sales_RollingStd4 FROM rolled2", LAGGED)


@oracle("impute_markdowns")
def _():
    return with_clean("SELECT Store, Dept, Date, " + ", ".join(f"COALESCE({c}, 0.0) AS {c}" for c in MD) + " FROM clean")


STORE_MED = """smed AS (SELECT Store, median(CPI) AS CPI_store_median, median(Unemployment) AS Unemployment_store_median
  FROM clean GROUP BY Store),
sfill AS (SELECT c.*, COALESCE(c.CPI, m.CPI_store_median) AS CPI_f,
                 COALESCE(c.Unemployment, m.Unemployment_store_median) AS Unemployment_f
  FROM clean c LEFT JOIN smed m ON c.Store = m.Store),
gmed AS (SELECT median(CPI_f) AS gcpi, median(Unemployment_f) AS gun FROM sfill),
efill AS (SELECT s.*, COALESCE(CPI_f, gcpi) AS CPI_e, COALESCE(Unemployment_f, gun) AS Unemployment_e
  FROM sfill s, gmed)"""


@oracle("store_medians")
def _():
    return with_clean("SELECT * FROM smed", STORE_MED)


@oracle("impute_economic")
def _():
    return with_clean("SELECT Store, Dept, Date, CPI_e AS CPI, Unemployment_e AS Unemployment FROM efill", STORE_MED)


@oracle("encode_features")
def _():
    return with_clean("""SELECT Store, Dept, Date, CAST(IsHoliday AS INTEGER) AS IsHoliday,
       CASE WHEN Type = 'A' THEN 1 ELSE 0 END AS Type_A, CASE WHEN Type = 'B' THEN 1 ELSE 0 END AS Type_B,
       CASE WHEN Type = 'C' THEN 1 ELSE 0 END AS Type_C FROM clean""")


FEATURES = """feat AS (
  SELECT r.Store, r.Dept, r.Date, r.Weekly_Sales, CAST(r.IsHoliday AS INTEGER) AS IsHoliday, r.Size,
         r.Temperature, r.Fuel_Price, """ + ", ".join(f"COALESCE(r.{c}, 0.0) AS {c}" for c in MD) + """,
         e.CPI_e AS CPI, e.Unemployment_e AS Unemployment,
         r.l1 AS Weekly_Sales_Lag1, r.l4 AS Weekly_Sales_Lag4, r.Weekly_Sales_RollingMean4,
         r.Weekly_Sales_RollingStd4,
         CASE WHEN r.Type = 'A' THEN 1 ELSE 0 END AS Type_A, CASE WHEN r.Type = 'B' THEN 1 ELSE 0 END AS Type_B,
         CASE WHEN r.Type = 'C' THEN 1 ELSE 0 END AS Type_C
  FROM rolled2 r JOIN efill e ON r.Store = e.Store AND r.Dept = e.Dept AND r.Date = e.Date
  WHERE r.l1 IS NOT NULL AND r.l4 IS NOT NULL AND r.Weekly_Sales_RollingMean4 IS NOT NULL
    AND r.Weekly_Sales_RollingStd4 IS NOT NULL)"""


@oracle("feature_table")
def _():
    return with_clean("SELECT * FROM feat", LAGGED + "," + STORE_MED + "," + FEATURES)


# ---- contract ----------------------------------------------------------------
BOUNDS = """cb AS (SELECT observed_min, observed_max,
       least(CAST(-5000.0 AS DOUBLE), round(observed_min * 1.1, 2)) AS min_bound,
       greatest(CAST(800000.0 AS DOUBLE), round(observed_max * 1.1, 2)) AS max_bound
  FROM (SELECT min(Weekly_Sales) AS observed_min, max(Weekly_Sales) AS observed_max FROM clean))"""


@oracle("contract_bounds")
def _():
    return with_clean("SELECT * FROM cb", BOUNDS)


_CONTRACT_TYPES = (("Store", "int", False), ("Dept", "int", False), ("Date", "datetime", False),
                   ("Weekly_Sales", "float", False), ("IsHoliday", "bool", False),
                   ("Type", "string", True), ("Size", "int", True), ("Temperature", "float", True),
                   ("Fuel_Price", "float", True), ("CPI", "float", True), ("Unemployment", "float", True),
                   *[(c, "float", True) for c in MD])
CHECKS = "checks AS (" + " UNION ALL ".join(
    [f"SELECT 'error' AS severity, 'dtype' AS rule, '{c}' AS column_name, CAST(0 AS BIGINT) AS violations"
     for c, _, _ in _CONTRACT_TYPES]
    + [f"SELECT 'error', 'not_null', '{c}', CAST(count_if({c} IS NULL) AS BIGINT) FROM clean"
       for c, _, nullable in _CONTRACT_TYPES if not nullable]
    + ["SELECT 'error', 'pk_null', 'Store,Dept,Date', CAST(count_if(Store IS NULL OR Dept IS NULL OR Date IS NULL) AS BIGINT) FROM clean",
       "SELECT 'error', 'pk_duplicate', 'Store,Dept,Date', CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM clean GROUP BY Store, Dept, Date)",
       "SELECT 'error', 'target_null', 'Weekly_Sales', CAST(count_if(Weekly_Sales IS NULL) AS BIGINT) FROM clean",
       "SELECT 'error', 'below_min', 'Weekly_Sales', CAST(count_if(Weekly_Sales < cb.min_bound) AS BIGINT) FROM clean, cb",
       "SELECT 'error', 'above_max', 'Weekly_Sales', CAST(count_if(Weekly_Sales > cb.max_bound) AS BIGINT) FROM clean, cb"]) + ")"


@oracle("contract_check")
def _():
    return with_clean("SELECT * FROM checks", BOUNDS + "," + CHECKS)


@oracle("contract_verdict")
def _():
    return with_clean("""SELECT CASE WHEN n_errors > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n_errors, n_warnings
FROM (SELECT CAST(count_if(severity = 'error' AND violations > 0) AS BIGINT) AS n_errors,
             CAST(count_if(severity = 'warning') AS BIGINT) AS n_warnings FROM checks)""", BOUNDS + "," + CHECKS)


@oracle("pk_duplicates")
def _():
    return with_clean("""SELECT CAST(COALESCE(SUM(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT COUNT(*) AS n FROM clean GROUP BY Store, Dept, Date)""")


# ---- split and metrics -------------------------------------------------------
FEAT_ALL = LAGGED + "," + STORE_MED + "," + FEATURES
CUT = """d AS (SELECT DISTINCT Date FROM feat),
nd AS (SELECT COUNT(*) AS n FROM d),
ix AS (SELECT n, greatest(0, least(CAST(n AS INTEGER) - 2,
                 CAST(floor(n * CAST(0.8 AS DOUBLE)) AS INTEGER) - 1)) AS idx FROM nd),
cut AS (SELECT CAST(ix.n AS BIGINT) AS n_dates, CAST(ix.idx AS INTEGER) AS cutoff_index,
               CASE WHEN ix.n >= 2 THEN r.Date END AS cutoff_date
        FROM ix LEFT JOIN (SELECT Date, row_number() OVER (ORDER BY Date) - 1 AS i FROM d) r ON r.i = ix.idx),
test AS (SELECT f.* FROM feat f, cut WHERE f.Date > cut.cutoff_date)"""


@oracle("chrono_cutoff")
def _():
    return with_clean("SELECT * FROM cut", FEAT_ALL + "," + CUT)


@oracle("chrono_split")
def _():
    return with_clean("SELECT Store, Dept, Date, Date <= cut.cutoff_date AS is_train FROM feat, cut",
                      FEAT_ALL + "," + CUT)


@oracle("split_summary")
def _():
    return with_clean("""SELECT cut.n_dates, cut.cutoff_date,
       CAST(count_if(f.Date <= cut.cutoff_date) AS BIGINT) AS train_rows,
       CAST(count_if(f.Date > cut.cutoff_date) AS BIGINT) AS test_rows
FROM feat f, cut GROUP BY cut.n_dates, cut.cutoff_date""", FEAT_ALL + "," + CUT)


@oracle("naive_metrics")
def _():
    return with_clean("""SELECT round(MAE, 6) AS MAE, round(RMSE, 6) AS RMSE,
       round(CASE WHEN sst = 0 THEN CASE WHEN sse = 0 THEN 1.0 ELSE 0.0 END ELSE 1.0 - sse / sst END, 6) AS R2
FROM (SELECT avg(abs(Weekly_Sales - Weekly_Sales_Lag1)) AS MAE,
             sqrt(avg((Weekly_Sales - Weekly_Sales_Lag1) * (Weekly_Sales - Weekly_Sales_Lag1))) AS RMSE,
             sum((Weekly_Sales - Weekly_Sales_Lag1) * (Weekly_Sales - Weekly_Sales_Lag1)) AS sse,
             var_pop(Weekly_Sales) * COUNT(Weekly_Sales) AS sst
      FROM test)""", FEAT_ALL + "," + CUT)


@oracle("sales_long")
def _():
    return with_clean(f"""SELECT Date, 'Weekly_Sales' AS Series, {mean_sql('Weekly_Sales')} AS Sales FROM test GROUP BY Date
UNION ALL
SELECT Date, 'Naive_Sales' AS Series, {mean_sql('Weekly_Sales_Lag1')} AS Sales FROM test GROUP BY Date""",
                      FEAT_ALL + "," + CUT)


# ---- ridge in closed form ----------------------------------------------------
RIDGE_FEATURES = ("IsHoliday", "Size", "Temperature", "Fuel_Price", *MD, "CPI", "Unemployment",
                  "Weekly_Sales_Lag1", "Weekly_Sales_Lag4", "Weekly_Sales_RollingMean4", "Weekly_Sales_RollingStd4",
                  "Type_A", "Type_B", "Type_C")
FITTED = "fitted AS (SELECT f.* FROM feat f, cut WHERE f.Date <= cut.cutoff_date)"


@oracle("ridge_moments")
def _():
    cols = (*RIDGE_FEATURES, "Weekly_Sales")
    cells = ", ".join(f"{{'col_a': '{a}', 'col_b': '{b}', 'mean_a': avg({a}), 'mean_b': avg({b}), 'cov': covar_pop({a}, {b})}}"
                      for i, a in enumerate(cols) for b in cols[i:])
    return with_clean(f"""SELECT c.col_a, c.col_b, n, round(c.mean_a, 4) AS mean_a, round(c.mean_b, 4) AS mean_b,
       round(sign(c.cov) * sqrt(abs(c.cov)), 3) AS spread
FROM (SELECT count(*) AS n, unnest([{cells}]) AS c FROM fitted)""", FEAT_ALL + "," + CUT + "," + FITTED)


def _ridge_scores() -> str:
    """CTEs up to ``scored`` (the hold-out with its prediction): the normal
    equations in units of each feature's deviation, solved by elimination."""
    k = len(RIDGE_FEATURES)
    dev = {c: f"coalesce(nullif(stddev_pop({c}), 0), 1)" for c in RIDGE_FEATURES}
    rows = ", ".join("[" + ", ".join(
        [f"covar_pop({a}, {b}) / ({dev[a]} * {dev[b]})" + (f" + 1.0::DOUBLE / (count(*) * {dev[a]} * {dev[a]})" if a == b else "") for b in RIDGE_FEATURES]
        + [f"covar_pop({a}, Weekly_Sales) / {dev[a]}"]) + "]" for a in RIDGE_FEATURES)
    means = ", ".join(f"avg({c})" for c in RIDGE_FEATURES)
    terms = " + ".join(f"b[{i + 1}] / dev[{i + 1}] * ({c} - mean[{i + 1}])" for i, c in enumerate(RIDGE_FEATURES))
    return FEAT_ALL + "," + CUT + "," + FITTED + f""",
system AS (SELECT [{rows}] AS m, [{means}] AS mean, [{', '.join(dev.values())}] AS dev, avg(Weekly_Sales) AS base FROM fitted),
solving AS (SELECT 1 AS k, m FROM system UNION ALL
  SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda x: x / r[k])
    ELSE list_transform(r, lambda x, j: x - r[k] * m[k][j] / m[k][k]) END) FROM solving WHERE k <= {k}),
solved AS (SELECT list_transform(m, lambda r: r[{k + 1}]) AS b FROM solving WHERE k = {k + 1}),
scored AS (SELECT test.*, base + {terms} AS prediction FROM test, system, solved)"""


def with_ridge(body: str) -> str:
    return with_clean(body, _ridge_scores()).replace("WITH", "WITH RECURSIVE", 1)


@oracle("ridge_forecast")
def _():
    return with_ridge(f"""SELECT Date, 'Weekly_Sales' AS Series, round({mean_sql('Weekly_Sales')}, 3) AS Sales FROM scored GROUP BY Date
UNION ALL SELECT Date, 'Ridge_Sales', round(avg(prediction), 3) FROM scored GROUP BY Date""")


def _metrics_sql(p: str) -> str:
    e = f"(Weekly_Sales - {p})"
    return (f"avg(abs({e})) AS MAE, sqrt(avg({e} * {e})) AS RMSE, "
            f"1 - sum({e} * {e}) / (var_pop(Weekly_Sales) * count(*)) AS R2")


@oracle("candidate_selection")
def _():
    return with_ridge(f"""SELECT model, round(MAE, 3) AS MAE, round(RMSE, 3) AS RMSE, round(R2, 6) AS R2,
       row_number() OVER (ORDER BY RMSE, place) = 1 AS selected
FROM (SELECT 'Ridge' AS model, 0 AS place, {_metrics_sql('prediction')} FROM scored
      UNION ALL SELECT 'LastWeek', 1, {_metrics_sql('Weekly_Sales_Lag1')} FROM scored)""")


# ---- ingest ------------------------------------------------------------------
@oracle("clean_panel")
def _():
    return with_clean("SELECT * FROM clean")


@oracle("scan_clean")
def _():
    return with_clean("SELECT * FROM clean")


@oracle("join_stores")
def _():
    return with_clean("""SELECT t.Store, t.Dept, t.Date, t.Weekly_Sales, t.IsHoliday, s.Type, s.Size
FROM train t LEFT JOIN stores s ON t.Store = s.Store""")


@oracle("join_features")
def _():
    return with_clean("""SELECT t.Store, t.Dept, t.Date, t.Weekly_Sales, t.IsHoliday, w.Temperature, w.Fuel_Price,
       w.MarkDown1, w.MarkDown2, w.MarkDown3, w.MarkDown4, w.MarkDown5, e.CPI, e.Unemployment
FROM train t LEFT JOIN wk w ON t.Store = w.Store AND t.Date = w.Date
             LEFT JOIN eco e ON t.Store = e.Store AND t.Date = e.Date""")


@oracle("join_key_check")
def _():
    return with_clean("""SELECT 'stores' AS source, Store, CAST(NULL AS DATE) AS Date, COUNT(*) AS n
FROM stores GROUP BY Store HAVING COUNT(*) > 1
UNION ALL
SELECT 'features' AS source, w.Store, w.Date, COUNT(*) AS n
FROM wk w LEFT JOIN eco e ON w.Store = e.Store AND w.Date = e.Date
GROUP BY w.Store, w.Date HAVING COUNT(*) > 1""")


@oracle("drop_null_keys")
def _():
    return with_clean("""SELECT COUNT(*) AS rows_in,
       CAST(count_if(Store IS NOT NULL AND Dept IS NOT NULL AND Date IS NOT NULL AND Weekly_Sales IS NOT NULL) AS BIGINT) AS rows_out,
       COUNT(*) - CAST(count_if(Store IS NOT NULL AND Dept IS NOT NULL AND Date IS NOT NULL AND Weekly_Sales IS NOT NULL) AS BIGINT) AS rows_dropped
FROM clean""")


@oracle("parse_dates")
def _():
    return with_clean("""SELECT Store, Dept, CAST(day(Date) AS VARCHAR) || '/' || CAST(month(Date) AS VARCHAR) || '/' || strftime(Date, '%Y') AS Date_text, Date
FROM train""")


@oracle("coerce_bool")
def _():
    return with_clean("""SELECT Store, Dept, Date, CASE WHEN IsHoliday THEN ' True ' ELSE 'false' END AS flag_text, IsHoliday
FROM train""")


# ---- the rules on rows that break them -------------------------------------
LINES = """WITH lines AS (
SELECT l_suppkey AS Store, CASE WHEN l_linenumber <> 7 THEN l_linenumber END AS Dept,
       CAST(l_shipdate AS DATE) AS Date,
       CASE WHEN l_returnflag = 'R' THEN -l_extendedprice WHEN l_tax = 0.08 THEN NULL ELSE l_extendedprice END AS Weekly_Sales,
       CASE l_returnflag WHEN 'A' THEN ' TRUE ' WHEN 'N' THEN 'false' ELSE 'yes' END AS flag_text,
       CASE l_linenumber % 4 WHEN 1 THEN strftime(l_shipdate, '%d/%m/%Y') WHEN 2 THEN strftime(l_shipdate, '%Y-%m-%d')
            WHEN 3 THEN '31/02/' || strftime(l_shipdate, '%Y')
            ELSE CAST(day(l_shipdate) AS VARCHAR) || '/' || CAST(month(l_shipdate) AS VARCHAR) || '/' || strftime(l_shipdate, '%Y') END AS date_text,
       CASE l_linenumber % 4 WHEN 1 THEN CAST(l_shipdate AS DATE) WHEN 0 THEN CAST(l_shipdate AS DATE) END AS parsed,
       CAST(l_linenumber AS VARCHAR) || CASE l_linenumber WHEN 1 THEN 'd' WHEN 2 THEN '.5' WHEN 3 THEN '.0' ELSE '' END AS number_text,
       l_linenumber AS line
FROM lineitem)
"""
LINE_CHECKS = LINES + """, checks AS (
SELECT 'error' AS severity, 'missing_column' AS rule, 'Size' AS column_name, CAST(1 AS BIGINT) AS violations
UNION ALL SELECT 'warning', 'unknown_dtype', 'flag_text', CAST(0 AS BIGINT)
UNION ALL SELECT 'error', 'dtype', c, CAST(0 AS BIGINT) FROM (VALUES ('Store'), ('Dept'), ('Date'), ('Weekly_Sales')) t(c)
UNION ALL SELECT 'error', 'dtype', 'number_text', CAST(count_if(line IN (1, 2)) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'not_null', 'Store', CAST(count_if(Store IS NULL) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'not_null', 'Dept', CAST(count_if(Dept IS NULL) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'not_null', 'Date', CAST(count_if(Date IS NULL) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'not_null', 'Weekly_Sales', CAST(count_if(Weekly_Sales IS NULL) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'pk_null', 'Store,Dept,Date', CAST(count_if(Store IS NULL OR Dept IS NULL OR Date IS NULL) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'target_null', 'Weekly_Sales', CAST(count_if(Weekly_Sales IS NULL) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'below_min', 'Weekly_Sales', CAST(count_if(Weekly_Sales < -5000) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'above_max', 'Weekly_Sales', CAST(count_if(Weekly_Sales > 50000) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'pk_duplicate', 'Store,Dept,Date', CAST(coalesce(sum(n - 1), 0) AS BIGINT)
FROM (SELECT count(*) AS n FROM lines GROUP BY Store, Dept, Date))
"""


@oracle("contract_check_lines")
def _():
    return LINE_CHECKS + "SELECT * FROM checks"


@oracle("contract_verdict_lines")
def _():
    return LINE_CHECKS + """SELECT CASE WHEN n_errors > 0 THEN 'FAIL' ELSE 'PASS' END AS status, n_errors, n_warnings
FROM (SELECT CAST(count_if(severity = 'error' AND violations > 0) AS BIGINT) AS n_errors,
             CAST(count_if(severity = 'warning') AS BIGINT) AS n_warnings FROM checks)"""


@oracle("pk_duplicates_lines")
def _():
    return LINES + """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT count(*) AS n FROM lines GROUP BY Store, Dept, Date)"""


@oracle("join_key_check_lines")
def _():
    return LINES + """SELECT 'stores' AS source, Store, CAST(NULL AS DATE) AS Date, count(*) AS n
FROM lines GROUP BY Store HAVING count(*) > 1
UNION ALL
SELECT 'features', Store, Date, count(*) FROM lines GROUP BY Store, Date HAVING count(*) > 1"""


@oracle("drop_null_keys_lines")
def _():
    return LINES + """SELECT count(*) AS rows_in, count(Store + Dept + Weekly_Sales) FILTER (Date IS NOT NULL) AS rows_out,
       count(*) - count(Store + Dept + Weekly_Sales) FILTER (Date IS NOT NULL) AS rows_dropped FROM lines"""


@oracle("parse_dates_mixed")
def _():
    return LINES + "SELECT date_text, count(*) AS n, any_value(parsed) AS parsed FROM lines GROUP BY date_text"


@oracle("coerce_bool_mixed")
def _():
    return LINES + """SELECT Store, flag_text, count(*) AS n,
       CASE flag_text WHEN ' TRUE ' THEN TRUE WHEN 'false' THEN FALSE END AS flag, flag_text <> 'false' AS flag_unknown_true
FROM lines GROUP BY Store, flag_text"""


@oracle("numbers_mixed")
def _():
    return LINES + """SELECT Store, number_text, count(*) AS n,
       any_value(CASE WHEN line > 2 THEN CAST(line AS BIGINT) END) AS whole,
       any_value(CASE WHEN line = 2 THEN 2.5::DOUBLE WHEN line > 2 THEN CAST(line AS DOUBLE) END) AS number
FROM lines GROUP BY Store, number_text"""


@oracle("contract_check_absent")
def _():
    return LINES + """SELECT 'error' AS severity, 'missing_column' AS rule, c AS column_name, CAST(1 AS BIGINT) AS violations
FROM (VALUES ('Branch'), ('Revenue')) t(c)
UNION ALL SELECT 'error', 'dtype', 'Store', CAST(0 AS BIGINT)
UNION ALL SELECT 'error', 'dtype', 'date_text', CAST(count_if(line % 4 <> 2) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'not_null', 'Store', CAST(count_if(Store IS NULL) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'pk_missing', 'Branch', CAST(1 AS BIGINT)
UNION ALL SELECT 'error', 'pk_null', 'Store', CAST(count_if(Store IS NULL) AS BIGINT) FROM lines
UNION ALL SELECT 'error', 'target_missing', 'Revenue', CAST(1 AS BIGINT)
UNION ALL SELECT 'error', 'pk_duplicate', 'Store', CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM lines GROUP BY Store)"""


@oracle("zero_sales_lines")
def _():
    return """SELECT l_suppkey AS Store, l_linenumber AS Dept, CAST(l_shipdate AS DATE) AS Date, CAST(0 AS DOUBLE) AS Weekly_Sales
FROM lineitem WHERE l_discount = 0 ORDER BY 1, 2, 3 LIMIT 15"""
