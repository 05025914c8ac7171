"""Centred second moments of many columns, as fixed-width aggregates.

Spark generates code for an aggregate only while its buffers stay under
``spark.sql.codegen.maxFields`` (100). A matrix of pairs exceeds that at once,
so the pairs are split into groups that fit, each one aggregation of one row
per task, and each pass reads only its own columns. Partial rows merge by
addition; nothing is exploded and no row is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Buffer fields that one aggregate may have, counts and flags of the plan apart.
FIELDS = 90

Pair = tuple[str, str]


def in_groups(pairs: list[Pair], fields) -> list[list[Pair]]:
    """Consecutive pairs whose buffer fields (by ``fields(pair)``) fit one aggregate."""
    groups: list[list[Pair]] = []
    room = 0
    for pair in pairs:
        need = fields(pair)
        if need > room:
            groups.append([])
            room = FIELDS
        groups[-1].append(pair)
        room -= need
    return groups


def by_groups(df: DataFrame, groups: list[list[Pair]], of_pair) -> DataFrame:
    """Rows (col_a, col_b, ...) from one aggregation a group; ``of_pair(a, b)``
    gives the aggregates of a pair by name."""
    parts = []
    for group in groups:
        aggs, cells = [], []
        for i, (a, b) in enumerate(group):
            named = of_pair(a, b)
            aggs += [c.alias(f"{n}{i}") for n, c in named.items()]
            cells.append(F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), *[F.col(f"{n}{i}").alias(n) for n in named]))
        columns = sorted({c for pair in group for c in pair})
        parts.append(df.select(*columns).agg(*aggs).select(F.inline(F.array(*cells))))
    return reduce(DataFrame.unionByName, parts)


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row per pair a <= b (in the order of ``cols``): col_a, col_b, n,
    mean_a, mean_b and comoment = sum((a - mean_a) * (b - mean_b)) over all
    rows, none of which may have a null.

    The columns are first moved by their means (one pass, a scalar subquery),
    so that sums of products lose no digits to large means; what rounding
    left of the means is taken out at the end. All sums of two tables' rows
    taken by the same centres add up to those of their union."""
    centre = df.agg(F.struct(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols])).scalar()
    moved = df.select(*[(F.col(c).cast("double") - centre[c]).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]

    def sums(a: str, b: str) -> dict:
        return {"n": F.count(F.lit(1)), "sa": F.sum(a), "sb": F.sum(b), "sab": F.sum(F.col(a) * F.col(b))}

    # equal aggregates of a group (n, a column's sum) are computed once: a product a pair, and the columns' own sums
    rows = by_groups(moved, in_groups(pairs, lambda _: 1.25), sums)
    means = F.create_map(*[x for c in cols for x in (F.lit(c), centre[c])])
    return rows.select(
        "col_a", "col_b", "n", (means[F.col("col_a")] + F.col("sa") / F.col("n")).alias("mean_a"),
        (means[F.col("col_b")] + F.col("sb") / F.col("n")).alias("mean_b"),
        (F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")).alias("comoment"))
