"""Exact quantiles (linear interpolation) and values at ranks, computed
without gathering a group's values into one task.

``percentile`` / ``median`` merge every distinct value of a group in one
task: fine for small groups, unbounded for a global quantile or a hot group.
Here the value counts per (group, value) are written once, and the wanted
ranks are found in them by radix selection. A double is read as digits of its
sign, exponent and mantissa that order as the values do (a date as its day
number):

1. the copies under each first digit of a group (sign, exponent, 10 bits of
   mantissa) are counted, and walked in order up to the wanted ranks;
2. the same for the second digit (21 bits) among the values under those;
3. and for the values themselves, which by then differ in 21 bits at most.

A walk over one group is bounded by about 2^22 steps however many values the
group has, and three of them settle any values, near to each other or many
orders of magnitude apart. Groups of at most ``WALK`` distinct values need the
last walk only; a second small job finds the widest one where all groups
together have more. Apart from that and the written counts nothing runs until
the result is asked for, and nothing is collected. The result depends on the values and their counts alone.

Rank r (0-based) of the expanded rows is covered by a value with
start <= r < end. With n rows, position = q * (n - 1), lo = floor, hi = ceil,
d = position - lo: quantile = (1 - d) * v_lo + d * v_hi. For the median
(d = 1/2) both products are exact, so the result equals the mean of the two
middle values bit for bit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salespanel.session import scratch_dir

# Distinct values of one group that are walked without narrowing them first.
WALK = 65_536
# Bits of the mantissa in the first and the second digit.
TOP_BITS, MIDDLE_BITS = 10, 21
# The least and the greatest exponent of a finite double.
LEAST_EXPONENT, GREATEST_EXPONENT = -1074, 1023


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(groups..., value, __w): non-null values with their multiplicity."""
    w = F.col(weight) if weight else F.lit(1)
    return (df.filter(F.col(value).isNotNull())
              .groupBy(*groups, value).agg(F.sum(w).cast("long").alias("__w")))


def with_digits(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` with __d0 and __d1, the first two digits of a double (not
    NaN): values order as (__d0, __d1, value). Dividing by a power of two and
    cutting off bits are exact, so no digit is rounded."""
    size, two = F.abs(F.col(value)), F.lit(2.0)
    endless = F.col("__size") == F.lit(float("inf"))
    near = F.floor(F.log2(F.when(~endless, F.col("__size")))).cast("int")  # may be one off beside a power of two
    near = F.greatest(F.least(near, F.lit(GREATEST_EXPONENT)), F.lit(LEAST_EXPONENT))
    e, power = F.col("__e"), F.pow(two, F.col("__e").cast("double"))
    low, high = F.col("__size") < power, F.col("__size") >= power * 2
    exact = F.when(low & (e > LEAST_EXPONENT), e - 1).when(high & (e < GREATEST_EXPONENT), e + 1).otherwise(e)
    rows = rows.withColumn("__size", size).withColumn("__e", near).withColumn("__e", exact)
    shown = (F.col("__size") / power - 1) * 2 ** TOP_BITS  # mantissa bits: the first digit's before the point
    first = ((e - LEAST_EXPONENT + 1).cast("long") * 2 ** TOP_BITS) + F.floor("__m")
    second = F.floor((F.col("__m") - F.floor("__m")) * 2 ** MIDDLE_BITS)
    past = F.lit((GREATEST_EXPONENT - LEAST_EXPONENT + 2) * 2 ** TOP_BITS).cast("long")
    sign = F.signum(F.col(value)).cast("int")
    return (rows.withColumn("__m", F.when(~endless & (F.col("__size") > 0), shown).otherwise(F.lit(0.0)))
                .withColumn("__d0", sign * F.when(endless, past).otherwise(first))
                .withColumn("__d1", sign * second).drop("__size", "__e", "__m"))


def _holding(counted: DataFrame, by: list[str], order: str, targets: Callable[[Column], Column]) -> DataFrame:
    """Walks rows of ``__w`` copies in order within ``by`` and keeps, as
    ``__at`` (__t, __r), each target whose rank the row's copies cover;
    ``__off`` becomes the copies before the row."""
    w = Window.partitionBy(*by)
    ends = F.sum("__w").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    walked = targets(counted, w).withColumn("__end", F.col("__off") + ends)
    start = F.col("__end") - F.col("__w")
    held = F.filter("__targets", lambda t: (start <= t["__r"]) & (t["__r"] < F.col("__end")))
    return walked.withColumn("__off", start).withColumn("__at", F.explode(held))


def stored(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` as a table in the application's scratch folder, reread, and its number of rows."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}/{uuid.uuid4().hex}"
    seen = Observation(name)
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def widest(counts: DataFrame, groups: Sequence[str], n: int, walk: int) -> int:
    """The most rows that a group has; n, the rows of all, if that settles it."""
    if n <= walk or not groups:
        return n
    return counts.groupBy(*groups).count().agg(F.max("count")).first()[0] or 0


def _select(counts: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], groups: Sequence[str], narrow: bool) -> DataFrame:
    """Per group: groups..., __n (its copies), and the value at each rank.
    Values may be spread over several rows of ``counts``."""
    is_date = isinstance(counts.schema[value].dataType, T.DateType)
    g = list(groups) or ["__all"]
    keys = [F.col(c) for c in groups] or [F.lit(0).alias("__all")]
    v = F.unix_date(value).cast("double") if is_date else F.col(value).cast("double")
    rows = counts.select(*keys, v.alias("__v"), "__w").filter(~F.isnan("__v"))
    wanted = F.array(*[F.struct(F.lit(t).alias("__t"), fn(F.col("__n")).cast("long").alias("__r")) for t, fn in ranks.items()])

    def first_targets(counted: DataFrame, w) -> DataFrame:
        return (counted.withColumn("__n", F.sum("__w").over(w)).withColumn("__off", F.lit(0).cast("long"))
                       .withColumn("__targets", wanted))

    if narrow:
        rows = with_digits(rows, "__v")
        found = _holding(rows.groupBy(*g, "__d0").agg(F.sum("__w").alias("__w")), g, "__d0", first_targets)
        for path, digit in ((["__d0"], "__d1"), (["__d0", "__d1"], "__v")):
            # the ranks of several targets often lie under one digit; they go on together
            state = found.groupBy(*g, *path, "__n", "__off").agg(F.collect_list("__at").alias("__targets"))
            state = state.withColumnsRenamed({c: f"__of_{c}" for c in [*g, *path]})
            on = F.lit(True)
            for c in [*g, *path]:
                on = on & F.col(c).eqNullSafe(F.col(f"__of_{c}"))
            met = rows.join(state, on).groupBy(*g, *path, digit).agg(
                F.sum("__w").alias("__w"), *[F.first(c).alias(c) for c in ("__n", "__off", "__targets")])
            found = _holding(met, [*g, *path], digit, lambda counted, w: counted)
    else:
        found = _holding(rows, g, "__v", first_targets)
    out = F.date_from_unix_date(F.col("__v").cast("int")) if is_date else F.col("__v")
    return found.groupBy(*groups).agg(F.max("__n").alias("__n"),
                                      *[F.max(F.when(F.col("__at.__t") == t, out)).alias(t) for t in ranks])


def quantiles_of_counts(counts: DataFrame, value: str, probs: Sequence[float], names: Sequence[str],
                        groups: Sequence[str], most: int, walk: int = WALK) -> DataFrame:
    """``exact_quantiles`` of value counts (groups..., value, __w) that need no
    writing: a stored table, or one cheap to compute again. ``most`` is a
    bound on the rows of a group."""
    def pos(n, p):
        return (n - 1).cast("double") * F.lit(float(p))

    ranks = {}
    for i, p in enumerate(probs):
        ranks[f"__lo{i}"] = lambda n, p=p: F.floor(pos(n, p))
        ranks[f"__hi{i}"] = lambda n, p=p: F.ceil(pos(n, p))
    out = _select(counts, value, ranks, groups, most > walk)
    cols = []
    for i, (p, name) in enumerate(zip(probs, names)):
        position = pos(F.col("__n"), p)
        frac = position - F.floor(position)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        cols.append(F.when((frac == 0) | (lo == hi), lo).otherwise((F.lit(1.0) - frac) * lo + frac * hi).alias(name))
    return out.select(*groups, *cols)


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str],
                    groups: Sequence[str] = (), weight: str | None = None, walk: int = WALK) -> DataFrame:
    """One row per group with one column per probability (``names``).

    ``weight`` (a count column) makes each row stand for that many rows, as
    for a histogram. Groups without values are absent; without ``groups``
    there is always one row. Null and NaN values don't count. ``walk`` does
    not change the result. The value counts are written when called (scratch
    folder, see ``session.clear_scratch``); the result is lazy."""
    counts, n = stored(value_counts(df, value, groups, weight), "value-counts")
    return quantiles_of_counts(counts, value, probs, names, groups, widest(counts, groups, n, walk), walk)


def evenly_spaced(counts: DataFrame, value: str, pieces: int, groups: Sequence[str], most: int, walk: int = WALK) -> DataFrame:
    """(groups..., value): the distinct values at the ranks floor(n * k / pieces),
    k from 0 to pieces - 1, of stored value counts; ``most`` bounds the rows of a group."""
    if most > walk:
        ranks = {f"r{k}": lambda n, k=k: F.floor(n * k / pieces) for k in range(pieces)}
        found = ranks_of_counts(counts, value, ranks, groups, most, walk)
        return found.select(*groups, F.explode(F.array_distinct(F.array(*ranks))).alias(value))
    w = Window.partitionBy(*groups)
    end = F.sum("__w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    walked = counts.filter(~F.isnan(F.col(value).cast("double"))).withColumns({"__n": F.sum("__w").over(w), "__end": end})
    # the first of the ranks that isn't before the value's copies, by whole numbers
    n, start = F.col("__n").cast("decimal(20,0)"), (F.col("__end") - F.col("__w")).cast("decimal(20,0)")
    k = F.ceil(start * pieces / n)
    rank = F.floor(n * k.cast("decimal(20,0)") / pieces)
    return walked.filter((k < pieces) & (rank < F.col("__end"))).select(*groups, F.col(value).cast("double").alias(value))


def ranks_of_counts(counts: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]], groups: Sequence[str],
                    most: int, walk: int = WALK) -> DataFrame:
    """``values_at_ranks`` of stored value counts (groups..., value, __w); ``most`` bounds the rows of a group."""
    return _select(counts, value, ranks, groups, most > walk).withColumnRenamed("__n", "n")


def values_at_ranks(df: DataFrame, value: str, ranks: dict[str, Callable[[Column], Column]],
                    groups: Sequence[str] = (), weight: str | None = None, walk: int = WALK) -> DataFrame:
    """Per group, the value at each computed rank: ``ranks`` maps an output
    name to a function of the group's row count n (a Column) giving a
    0-based rank. One row per group: groups..., n, <names>. Dates and doubles."""
    counts, n = stored(value_counts(df, value, groups, weight), "value-counts")
    return ranks_of_counts(counts, value, ranks, groups, widest(counts, groups, n, walk), walk)
