"""The retail panel derived from the TPC-H-style driver tables.

Gives the three sources the engine expects (stores, features, train) from
``lineitem``, ``orders``, ``supplier``, ``customer`` and ``nation``:
Store = supplier nation, Dept = line number, Date = Monday of the ship week,
Weekly_Sales = net revenue with returned lines negative, markdowns = discount
amounts per order priority, Temperature / Fuel_Price = mean quantity / tax of
the week's lines, CPI / Unemployment = order-side weekly means by customer
nation.

Plan shape (what matters at scale): one pass over the line items, joined to
suppliers (nation) and orders (priority); AQE broadcasts a side only when its
measured size allows, otherwise each join shuffles the line items once. Then
ONE aggregation to the finest grain (Store, Dept, Date) that also carries the
decomposable partial sums the features table needs; the (Store, Date)
features are a re-aggregation of that already small result, so the big join
is computed once and never re-read. Money is summed as exact scaled integers,
so partial aggregation in any order gives the exact same value.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salespanel.session import shared_dir

# Fixed values of the derived panel.
HOLIDAY_WEEKS = (6, 36, 47, 52)
STORE_TYPES_BY_REGION_MOD3 = ("A", "B", "C")
PRIORITY_PREFIXES = ("1", "2", "3", "4", "5")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _week(c):
    """Monday of the week, computed on the calendar date (no time-zone
    conversion of the timestamp, so the session zone cannot shift it)."""
    return F.trunc(c.cast("date"), "week")


def _scaled(c, places: int):
    """A money/rate value with ``places`` decimals as an exact LONG count of
    10^-places units (the values carry at most that many decimals)."""
    return F.round(F.col(c) * F.lit(10.0 ** places)).cast("long")


def _fine_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Store, Dept, Date) aggregates of the line items, including the partial
    sums the (Store, Date) features need.

    Money is summed as exact LONG counts of 1e-4 (price in cents x discount
    in hundredths) rather than wide DECIMALs: same exact result, but the
    arithmetic and the aggregation buffers stay primitive (a DECIMAL wider
    than 18 digits is a BigDecimal object per row). A per-group overflow
    raises (ANSI) instead of wrapping."""
    # Per-line values are computed right after the scan, before any join, so
    # the two shuffles of the line items (supplier key, order key) carry only
    # compact numbers instead of the raw price / flag / timestamp columns.
    price, disc, tax = _scaled("l_extendedprice", 2), _scaled("l_discount", 2), _scaled("l_tax", 2)
    sign = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.lit(1))
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", F.col("l_linenumber").alias("Dept"),
        _week(F.col("l_shipdate")).alias("Date"), "l_quantity",
        (price * (F.lit(100) - disc) * sign).alias("net4"),
        (price * disc).alias("md4"), tax.alias("tax2"))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("Store"))
    od = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("prio"))
    lines = (li.join(sup, li.l_suppkey == sup.s_suppkey)
               .join(od, li.l_orderkey == od.o_orderkey))
    return (lines
            .groupBy("Store", "Dept", "Date")
            .agg(F.sum("net4").alias("net4"),
                 F.sum("l_quantity").alias("qty"),
                 F.count(F.lit(1)).alias("n"),
                 F.sum("tax2").alias("tax2"),
                 *[F.sum(F.when(F.col("prio") == p, F.col("md4"))).alias(f"md{i + 1}")
                   for i, p in enumerate(PRIORITY_PREFIXES)]))


def _is_holiday(date_col):
    return F.weekofyear(date_col).isin(*HOLIDAY_WEEKS)


def raw_tables(spark: SparkSession, sf_dir: str, fine: DataFrame | None = None) -> dict[str, DataFrame]:
    """The three typed sources {stores, features, train} of the panel.
    ``fine`` lets a caller share one (persisted) fine-grain aggregate between
    ``train`` and ``features``."""
    fine = _fine_grain(spark, sf_dir) if fine is None else fine

    train = fine.select(
        "Store", "Dept", "Date",
        (F.col("net4").cast("double") / F.lit(1e4)).alias("Weekly_Sales"),
        _is_holiday(F.col("Date")).alias("IsHoliday"))

    sup = table(spark, sf_dir, "supplier").select("s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    a, b, c = STORE_TYPES_BY_REGION_MOD3
    stores = (sup.join(nat, sup.s_nationkey == nat.n_nationkey)
              .groupBy("n_nationkey", "n_regionkey").agg(F.count(F.lit(1)).alias("cnt"))
              .select(F.col("n_nationkey").alias("Store"),
                      F.when(F.col("n_regionkey") % 3 == 0, a)
                       .when(F.col("n_regionkey") % 3 == 1, b).otherwise(c).alias("Type"),
                      (F.col("cnt") * 1000 + F.col("n_nationkey")).cast("int").alias("Size")))

    wk = (fine.groupBy("Store", "Date")
          .agg(F.sum("qty").alias("qty"), F.sum("n").alias("n"), F.sum("tax2").alias("tax2"),
               *[F.sum(f"md{i}").alias(f"md{i}") for i in range(1, 6)])
          .select("Store", "Date",
                  (F.col("qty") / F.col("n")).alias("Temperature"),
                  (F.col("tax2").cast("double") / F.lit(100.0) / F.col("n")).alias("Fuel_Price"),
                  *[(F.col(f"md{i}").cast("double") / F.lit(1e4)).alias(f"MarkDown{i}") for i in range(1, 6)]))

    od = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    cu = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    finished = F.col("o_orderstatus") == "F"
    eco = (od.join(cu, od.o_custkey == cu.c_custkey)
           .select(F.col("c_nationkey").alias("Store"), _week(F.col("o_orderdate")).alias("Date"),
                   _scaled("o_totalprice", 2).alias("tp2"),
                   F.when(finished, _scaled("c_acctbal", 2)).alias("bal2"),
                   F.when(finished, F.lit(1)).alias("fin"))
           .groupBy("Store", "Date")
           .agg((F.sum("tp2").cast("double") / F.lit(100.0) / F.count(F.lit(1))).alias("CPI"),
                (F.sum("bal2").cast("double") / F.lit(100.0)
                 / F.nullif(F.count("fin"), F.lit(0))).alias("Unemployment")))

    # Every (Store, Date) of train has a row in wk (same line items, coarser
    # grain), so train x (wk x eco) equals train x wk x eco.
    features = (wk.join(eco, ["Store", "Date"], "left")
                .withColumn("IsHoliday", _is_holiday(F.col("Date"))))
    return {"stores": stores, "features": features, "train": train}


SOURCE_NAMES = ("stores", "features", "train")


def materialize_sources(spark: SparkSession, sf_dir: str, path: str) -> dict[str, DataFrame]:
    """Derive the sources once and write them as Parquet under ``path`` (a
    folder in the shared directory). The fine-grain aggregate both
    ``train`` and ``features`` come from is persisted for the writes, so
    the line-item join is computed once; it is released right after. The
    three writes run concurrently.
    Returns readers of the written tables (lineage starts there)."""
    fine = _fine_grain(spark, sf_dir).persist()

    def write(item):
        name, df = item
        df.write.mode("overwrite").parquet(f"{path}/{name}")

    try:
        # three independent jobs submitted together; a cached partition that
        # two of them need is computed once (the second waits for the block)
        with ThreadPoolExecutor(max_workers=3) as pool:
            list(pool.map(write, raw_tables(spark, sf_dir, fine).items()))
    finally:
        fine.unpersist()
    return read_sources(spark, path)


def written_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The sources of a run, derived once into a new folder of the shared
    directory: no later step reads the line items again."""
    return materialize_sources(spark, sf_dir, f"{shared_dir(spark)}/salespanel-sources/{uuid.uuid4().hex}")


def read_sources(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in SOURCE_NAMES}
