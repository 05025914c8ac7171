"""One-hot encoding of any number of categories.

``encode_categoricals`` of ``features`` has a column per category, as wide as
the data and so bounded. Here the categories are fitted once into a written
table (value, index), in sorted order, and a row gets one sparse vector by a
join with it. Building that plan runs no job, and a vector takes the same room
however many categories there are. The vector goes into Spark ML as it is.

Ranks come from one range partitioned sort and the counts of its partitions,
so no task orders all categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salespanel.operators.quantiles import stored


@dataclass
class Categories:
    """A fitted column: its written table (value, index) and the number of its values."""

    column: str
    table: DataFrame
    size: int


def fit_categories(df: DataFrame, column: str = "Type") -> Categories:
    """The distinct non-null values of a column, numbered in sorted order."""
    values = df.select(F.col(column).alias("value")).dropna().distinct()
    placed, size = stored(values.repartitionByRange("value").sortWithinPartitions("value").withColumn(
        "at", F.monotonically_increasing_id()), "categories")
    part = F.shiftright("at", 33)  # the partition that wrote the row
    held = placed.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # a row a partition
    held = held.select("part", (before - F.col("first")).alias("shift"))
    table, _ = stored(placed.withColumn("part", part).join(held, "part").select(
        "value", (F.col("at") + F.col("shift")).alias("index")), "categories")
    return Categories(column, table, size)


def encode_sparse(df: DataFrame, fitted: Categories, output: str | None = None) -> DataFrame:
    """``df`` with its category column replaced by a sparse vector of
    ``fitted.size``: 1 at the value's index, all zeros for a null or a value that
    was not fitted. AQE broadcasts the category table only when its measured
    size allows."""
    output = output or f"{fitted.column}_vector"
    names = [c for c in df.columns if c != fitted.column]
    if not fitted.size:
        return df.select(*names)
    known = fitted.table.select(F.col("value").alias(fitted.column), F.col("index").alias("__index"))
    # what is not known is one index more, which the encoder drops; the size goes along, so that it looks at no row
    size = {"ml_attr": {"type": "nominal", "num_vals": fitted.size + 1}}
    index = F.coalesce(F.col("__index"), F.lit(fitted.size)).cast("double").alias("__index", metadata=size)
    joined = df.join(known, fitted.column, "left").select(*names, index)
    encoder = OneHotEncoder(inputCols=["__index"], outputCols=[output], dropLast=True)
    return encoder.fit(joined).transform(joined).drop("__index")
