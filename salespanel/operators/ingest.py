"""Ingest: join train -> stores -> features into the clean (Store, Dept, Date)
panel, drop rows without key or target, and guarantee many-to-one joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salespanel.functions.scalar import nan_to_null
from salespanel.schemas import CLEAN_COLUMNS, PRIMARY_KEYS, TARGET


#: The most bytes of store attributes that are sent to every task of the store join.
BROADCAST_BYTES = 32 * 1024 * 1024


class DataIngestionError(Exception):
    """Raised when sources are missing or violate the join contract."""


def duplicate_keys(df: DataFrame, keys: list[str] | tuple[str, ...]) -> DataFrame:
    """Keys that occur more than once (null keys compare equal, as in a
    groupBy). One shuffle aggregation on the key; map-side partial counts
    keep it cheap even when a single key is hot."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > 1))


def join_key_violations(stores: DataFrame, features: DataFrame) -> DataFrame:
    """All right-side keys that would break a many-to-one join, as rows
    (source, Store, Date, n). Empty when both joins are safe."""
    s = duplicate_keys(stores, ["Store"]).select(
        F.lit("stores").alias("source"), "Store", F.lit(None).cast("date").alias("Date"), "n")
    f = duplicate_keys(features, ["Store", "Date"]).select(
        F.lit("features").alias("source"), "Store", "Date", "n")
    return s.unionByName(f)


def assert_many_to_one(stores: DataFrame, features: DataFrame, show: int = 10) -> None:
    """Raise naming the offending keys when a right side repeats a key."""
    found = join_key_violations(stores, features)
    bad = found.limit(show).collect()
    if bad:
        keys = ", ".join(f"{r.source}(Store={r.Store}, Date={r.Date}) x{r.n}" for r in bad)
        raise DataIngestionError(f"join is not many-to-one; repeated right keys: {keys} "
                                 f"({len(bad)} of {found.count()} shown)")


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows and text bytes fit
    ``limit``; as it is otherwise (the join is then shuffled)."""
    text = [F.octet_length(c) for c, t in df.dtypes if t == "string"]
    r = df.agg(F.count(F.lit(1)).alias("n"),
               *[F.coalesce(F.sum(t), F.lit(0)).alias(f"t{i}") for i, t in enumerate(text)]).first()
    size = r["n"] * 16 * len(df.columns) + sum(r[f"t{i}"] for i in range(len(text)))
    return F.broadcast(df) if size <= limit else df


def join_stores(train: DataFrame, stores: DataFrame) -> DataFrame:
    """train LEFT JOIN stores ON Store (store attributes per sales row)."""
    return train.join(stores, "Store", "left")


def join_features(df: DataFrame, features: DataFrame) -> DataFrame:
    """LEFT JOIN features ON (Store, Date). The train-side IsHoliday wins:
    the features copy is dropped before the join, so it never clashes."""
    if "IsHoliday" in features.columns:
        features = features.drop("IsHoliday")
    return df.join(features, ["Store", "Date"], "left")


def drop_null_keys(df: DataFrame, observation: Observation | None = None) -> DataFrame:
    """Drop rows null in any key or the target. With ``observation`` the
    number of rows in and out is recorded on the first action (no extra
    pass over the data); make that action a write or collect, not a global
    sort, whose sampling pass would be observed as well."""
    subset = [*PRIMARY_KEYS, TARGET]
    if observation is None:
        return df.dropna(subset=subset)
    keep = F.lit(True)
    for c in subset:
        keep = keep & F.col(c).isNotNull()
    return (df.observe(observation, F.count(F.lit(1)).alias("rows_in"),
                       F.count_if(keep).alias("rows_out"))
              .filter(keep))


def select_stores(df: DataFrame, stores) -> DataFrame:
    """Rows of the given stores only (an ``isin`` filter that reaches the
    Parquet scan as a pushed-down ``In`` predicate)."""
    return df.filter(F.col("Store").isin(*list(stores)))


def normalize_nan(df: DataFrame) -> DataFrame:
    """NaN -> null in every floating column: NaN and null are one thing here
    (Spark would otherwise rank NaN above every number)."""
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: nan_to_null(c) for c in floats}) if floats else df


def cast_clean(df: DataFrame) -> DataFrame:
    """Key and target types (keys of any integral type stay as they are), then
    the clean column order (extra columns last)."""
    whole = {c: F.col(c) if isinstance(df.schema[c].dataType, T.IntegralType) else F.col(c).cast("bigint")
             for c in ("Store", "Dept")}
    df = (df.withColumns(whole)
            .withColumn("Date", F.col("Date").cast("date"))
            .withColumn(TARGET, F.col(TARGET).cast("double")))
    order = [c for c in CLEAN_COLUMNS if c in df.columns]
    return df.select(*order, *[c for c in df.columns if c not in order])


def ingest(sources: dict[str, DataFrame], check_keys: bool = True,
           observation: Observation | None = None) -> DataFrame:
    """The clean panel from {stores, features, train}.

    Join plan: train LEFT JOIN stores ON Store, then LEFT JOIN features ON
    (Store, Date). Store alone is a key of few values, so with ``check_keys``
    the stores are measured too and broadcast if they fit ``BROADCAST_BYTES``:
    train is then not shuffled on it. The store-weeks are joined plainly, and
    AQE broadcasts them only when their measured shuffle output is small. The order of output rows is not a physical
    sort; consumers that need (Store, Dept, Date) order express it in their
    window or sort.
    """
    stores, features, train = sources["stores"], sources["features"], sources["train"]
    if check_keys:
        assert_many_to_one(stores, features)
        stores = broadcast_if_small(stores)
    merged = normalize_nan(join_features(join_stores(train, stores), features))
    return cast_clean(drop_null_keys(merged, observation))
