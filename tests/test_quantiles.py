"""Exact quantiles agree with DuckDB's quantile_cont however far they are narrowed."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from salespanel.operators import quantiles
from salespanel.operators.quantiles import exact_quantiles, values_at_ranks


@pytest.fixture(scope="module")
def data():
    rnd = random.Random(11)
    rows = []
    for g in range(120):
        for _ in range(rnd.choice([1, 2, 3, 8, 60])):
            v = None if rnd.random() < 0.1 else round(rnd.uniform(-1e4, 1e4), rnd.choice([0, 2, 4]))
            rows.append((g % 5, g, v))
    rows += [(9, 999, float(rnd.randint(0, 3000))) for _ in range(5000)]   # a hot group
    return rows


def duck(rows, sql):
    pdf = pd.DataFrame(rows, columns=["a", "g", "v"])  # noqa: F841 (read by duckdb)
    return duckdb.connect().execute(sql).fetchall()


@pytest.mark.parametrize("walk,top,middle", [(65_536, 10, 21), (0, 10, 21), (0, 0, 3), (0, 25, 20)])
def test_grouped_median_and_quartiles(spark, data, walk, top, middle, monkeypatch):
    monkeypatch.setattr(quantiles, "TOP_BITS", top)
    monkeypatch.setattr(quantiles, "MIDDLE_BITS", middle)
    df = spark.createDataFrame(data, "a int, g int, v double")
    got = {(r.a, r.g): (r.q1, r.m, r.q3) for r in
           exact_quantiles(df, "v", [0.25, 0.5, 0.75], ["q1", "m", "q3"], groups=["a", "g"], walk=walk).collect()}
    exp = {(a, g): (q1, m, q3) for a, g, q1, m, q3 in duck(
        data, "select a, g, quantile_cont(v, 0.25), median(v), quantile_cont(v, 0.75) "
              "from pdf where v is not null group by a, g")}
    assert set(got) == set(exp)
    for k, (q1, m, q3) in exp.items():
        assert got[k][1] == m                                  # medians: bit for bit
        assert abs(got[k][0] - q1) <= 1e-9 * max(1.0, abs(q1))
        assert abs(got[k][2] - q3) <= 1e-9 * max(1.0, abs(q3))


def test_global_weighted(spark):
    rows = [(1.0, 3), (2.0, 1), (10.0, 2)]   # expands to 1, 1, 1, 2, 10, 10
    df = spark.createDataFrame(rows, "v double, w long")
    r = exact_quantiles(df, "v", [0.5, 0.75], ["m", "q3"], weight="w", walk=0).first()
    assert r.m == 1.5 and r.q3 == 8.0


from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50), st.integers(1, 4)), min_size=1, max_size=60),
       st.sampled_from([0.1, 0.25, 0.5, 0.75, 0.9]))
def test_weighted_matches_numpy(spark, rows, p):
    import numpy as np
    df = spark.createDataFrame([(g, float(v) / 4, w) for g, v, w in rows], "g int, v double, w long")
    got = {r.g: r.q for r in exact_quantiles(df, "v", [p], ["q"], groups=["g"], weight="w", walk=2).collect()}
    for g in {r[0] for r in rows}:
        expanded = [float(v) / 4 for gg, v, w in rows if gg == g for _ in range(w)]
        want = float(np.percentile(expanded, p * 100, method="linear"))
        assert abs(got[g] - want) <= 1e-12 * max(1.0, abs(want))


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_many_values_without_exchange_reuse(spark, reuse):
    """400,000 distinct values, infinities and wide spans; a result must not
    rest on two copies of a plan being computed alike."""
    n = 400_000
    df = spark.range(n, numPartitions=8).selectExpr("id % 2 AS g", "pmod(xxhash64(id), 1000003) * 1.5 + id * 1e-7 AS v")
    df = df.unionByName(spark.createDataFrame([(0, float("inf")), (1, float("-inf")), (1, 1e308), (1, -1e308)], "g long, v double"))
    pdf = df.toPandas()  # noqa: F841 (read by duckdb)
    want = {g: (q1, m) for g, q1, m in duckdb.connect().execute(
        "select g, quantile_cont(v, 0.25), median(v) from pdf group by g").fetchall()}
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        got = {r.g: (r.q1, r.m) for r in exact_quantiles(df, "v", [0.25, 0.5], ["q1", "m"], groups=["g"], walk=500).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    for g, (q1, m) in want.items():
        assert got[g][1] == m and abs(got[g][0] - q1) <= 1e-9 * abs(q1)


def test_dates_at_ranks_and_empty(spark):
    df = spark.range(300_000, numPartitions=8).selectExpr("date_add(DATE'1600-01-01', cast(id AS int)) AS d")
    r = values_at_ranks(df, "d", {"x": lambda n: n - 100_000}, walk=100).first()
    assert r.n == 300_000 and r.x == df.selectExpr("date_add(DATE'1600-01-01', 200000)").first()[0]
    none = spark.createDataFrame([], "g int, v double")
    assert exact_quantiles(none, "v", [0.5], ["m"], groups=["g"]).count() == 0
    assert exact_quantiles(none, "v", [0.5], ["m"]).first().m is None


def test_sums_keep_every_digit(spark):
    from salespanel.functions.scalar import exact_mean, exact_sum, number_text
    def both(*v):
        return tuple(spark.createDataFrame([(x,) for x in v], "v double").select(exact_sum("v"), exact_mean("v")).first())
    assert both(0.00004, 0.00004) == (0.00008, 0.00004)
    assert both(float("inf"), 2.0) == (float("inf"), float("inf"))
    assert both(2e14, 1.0) == (2e14 + 1, (2e14 + 1) / 2)
    assert both(0.1, 0.2, None) == (0.3, 0.15) and both(None) == (None, None)
    rows = spark.createDataFrame([(t,) for t in ("1d", "0x1p3", "1f", " 12.5 ", "-1e3", ".5", "inf")], "t string")
    assert [r[0] for r in rows.select(number_text("t").try_cast("double")).collect()] == [None, None, None, 12.5, -1000.0, 0.5, float("inf")]


def test_fence_is_not_rounded(spark):
    from salespanel.operators import inspect as insp
    df = spark.sql("SELECT 1 AS Store, cast(id AS int) AS Dept, DATE'2020-01-06' AS Date, 1.0D AS Weekly_Sales, "
                   "(id + 1) * 1e-8 AS MarkDown1 FROM range(8)")
    assert insp.markdown_outliers(df).count() == 0 and insp.rows_above_fence(df).first()[0] == 0


def test_values_of_every_magnitude(spark):
    """Subnormal to huge, both signs and zeros, infinities, values next to each other: each rank is settled."""
    import numpy as np
    rnd = random.Random(5)
    v = [s * rnd.random() * 10.0 ** e for e in range(-320, 309, 3) for s in (1, -1)] + [0.0, -0.0, 5e-324, -5e-324, float("inf"), float("-inf")]
    v += [float(np.nextafter(1.5, 2)), 1.5, float(np.nextafter(1.5, 1))] * 40 + [float("nan")]
    df = spark.createDataFrame([(x,) for x in v], "v double").repartition(5)
    n = len(v) - 1
    want = sorted(x for x in v if x == x)
    probes = {f"r{k}": (lambda c, k=k: F.lit(k)) for k in range(0, n, 17)}
    got = values_at_ranks(df, "v", probes, walk=0).first().asDict()
    assert got.pop("n") == n
    assert got == {f"r{k}": want[k] for k in range(0, n, 17)}


def test_digits_sort_as_values(spark):
    """Digits order as the values, and hold all but the last 21 bits of a mantissa; also beside powers of two."""
    import numpy as np
    rnd = random.Random(2)
    v = [0.0, float("inf"), 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308]
    for e in range(-1074, 1024, 7):
        p = 2.0 ** e
        v += [p, float(np.nextafter(p, 0)), float(np.nextafter(p, np.inf)), p * (1 + rnd.random())]
    v = sorted({x * s for x in v for s in (1, -1)})
    df = spark.createDataFrame([(x,) for x in v], "v double")
    got = {r.v: (r.a, r.b) for r in quantiles.with_digits(df, "v").select("v", F.col("__d0").alias("a"), F.col("__d1").alias("b")).collect()}
    digits = [got[x] for x in v]
    assert digits == sorted(digits)
    for x, (a, b) in got.items():
        m, e = np.frexp(abs(x)) if 0 < abs(x) < float("inf") else (0.5, 0)
        bits = int((m * 2 - 1) * 2 ** 31) if x else 0
        assert abs(b) == bits % 2 ** 21 and (not 0 < abs(x) < float("inf") or abs(a) % 2 ** 10 == bits >> 21)


def test_the_selection_is_lazy(spark, data):
    """Jobs run for the value counts and the widest group, not for the selection."""
    sc = spark.sparkContext
    df = spark.createDataFrame(data, "a int, g int, v double")
    counts, n = quantiles.stored(quantiles.value_counts(df, "v", ["a"]), "value-counts")
    assert n == counts.count() and quantiles.widest(counts, ["a"], n, 0) < n == quantiles.widest(counts, ["a"], n, n)
    sc.setJobGroup("plan-only", "quantiles")
    try:
        out = quantiles.quantiles_of_counts(counts, "v", [0.5], ["m"], ["a"], 10 ** 9)
        assert not sc.statusTracker().getJobIdsForGroup("plan-only")
        assert out.count() == 6 and sc.statusTracker().getJobIdsForGroup("plan-only")
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_sums_of_large_values_and_of_nulls(spark):
    from salespanel.functions.scalar import exact_sum
    df = spark.range(3).select(F.lit(1e13).alias("v"))
    assert df.select(exact_sum("v")).first()[0] == 3e13
    few = spark.range(4).select(F.lit(None).cast("double").alias("v"))
    assert few.select(exact_sum("v")).first()[0] is None


@pytest.mark.parametrize("walk", [0, 10 ** 6])
def test_evenly_spaced_values(spark, walk):
    rnd = random.Random(9)
    rows = [(g, float(v), rnd.randint(1, 9)) for g, k in ((1, 300), (2, 3), (3, 1), (4, 64)) for v in rnd.sample(range(-500, 500), k)]
    df = spark.createDataFrame(rows, "g int, v double, __w long")
    got = {}
    for r in quantiles.evenly_spaced(df, "v", 64, ["g"], 300, walk).collect():
        got.setdefault(r.g, []).append(r.v)
    for g in (1, 2, 3, 4):
        each = sorted(v for gg, v, w in rows if gg == g for _ in range(w))
        assert sorted(got[g]) == sorted({each[len(each) * k // 64] for k in range(64)})
