"""Mixing sources to target weights.

Words are summed per source, targets follow from weights and a cap on
repetition, and each document is taken ``floor(rate)`` times plus once more
with the rate's fraction as probability, drawn from a hash of the document:
reruns agree, and no row waits for another.

Defined results: a null text has size 0; null is a source of its own, last in
order; equal rows draw alike; a source without words keeps its documents once;
an empty table gives an empty mix; other columns pass through untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salespanel.llm.common import WORD, keep_columns, shielded, table

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = "mix-1"
#: Sources up to which the table of targets (some 100 bytes a row) is broadcast.
BROADCAST_SOURCES = 100_000


def size_in_words(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """One row per source of (source, size): source_size, weight and target.

    The targets share all words by weight, none above ``cap`` times its
    source: a source is capped exactly if, at the level where it would fill
    up, the others still leave words to share. Sources are taken in the order
    of that level, so one running sum over the table of sources decides it."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    w = per_source.withColumn("weight", F.element_at(
        F.array(*[F.lit(x) for x in weights]),
        ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")).cast("decimal(38,0)"))
    room = (F.col("source_size") * cap).cast("decimal(38,0)")
    by_level = Window.orderBy((F.col("source_size").cast("double") / F.col("weight").cast("double")).asc(),
                              F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = (w.withColumn("room", room)
         .withColumn("total", F.sum("source_size").over(everything).cast("decimal(38,0)"))
         .withColumn("room_before", F.coalesce(F.sum("room").over(by_level.rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0)).cast("decimal(38,0)"))
         .withColumn("weight_from", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)).cast("decimal(38,0)")))
    wide = "decimal(38,0)"
    full = ((F.col("room_before") * F.col("weight")).cast(wide) + (F.col("room") * F.col("weight_from")).cast(wide)
            <= (F.col("total") * F.col("weight")).cast(wide))
    w = w.withColumn("full", full)
    left = (F.col("total").cast("double")
            - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(everything), F.lit(0)).cast("double"))
    shared = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything), F.lit(1)).cast("double")
    return w.select("source", "source_size", F.col("weight").cast("int").alias("weight"), F.when(
        F.col("full"), F.col("room").cast("double")).otherwise(F.col("weight").cast("double") * left / shared).alias("target"))


def copies_column(doc_id, text, rate, seed: str = SEED):
    """floor(rate) copies and one more if the document's draw is under the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat_ws(
        ":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))), 1, 8),
        16, 10).cast("double") / F.lit(4294967296.0)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


@shielded("doc_id", "text", "source")
def mix_rates(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """``docs`` and the columns _mix_size, _mix_source_size, _mix_target and _mix_copies."""
    sized = docs.withColumn("_mix_size", size_in_words(F.col("text")))
    targets = source_targets(sized.select("source", F.col("_mix_size").alias("size")), weights, cap)
    t = targets.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_source_size"),
                       F.col("target").alias("_mix_target"))
    if t.count() <= BROADCAST_SOURCES:
        t = F.broadcast(t)
    out = sized.join(t, F.col("source").eqNullSafe(F.col("_mix_source")), "left").drop("_mix_source")
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(F.lit(1.0))
    return out.withColumn("_mix_copies", copies_column(F.col("doc_id"), F.col("text"), rate, seed))


@shielded("doc_id", "text", "source")
def mixed(docs: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns of ``docs``."""
    return (mix_rates(docs, weights, cap, seed)
            .withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))


def query(spark, sf_dir) -> DataFrame:
    docs = keep_columns(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string", "source": "string"})
    return mix_rates(docs).select(
        "doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"), (F.col("_mix_copies") * F.col("_mix_size")).alias("taken"))


ORACLE = """
WITH sized AS (
  SELECT doc_id, text, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
per_source AS (
  SELECT source, sum(size)::HUGEINT AS z, row_number() OVER (ORDER BY source NULLS LAST) AS k
  FROM sized GROUP BY source),
weighed AS (
  SELECT source, z, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS w,
         sum(z) OVER ()::HUGEINT AS total FROM per_source),
judged AS (
  SELECT a.source, a.z, a.w, a.total,
         (SELECT sum(least(3 * b.z * a.w, 3 * a.z * b.w)) FROM weighed b) <= a.total * a.w AS filled
  FROM weighed a),
targets AS (
  SELECT source, z, CASE WHEN filled THEN (3 * z)::DOUBLE ELSE w::DOUBLE
           * (total::DOUBLE - coalesce(sum(3 * z) FILTER (filled) OVER (), 0)::DOUBLE)
           / (sum(w) FILTER (NOT filled) OVER ())::DOUBLE END AS target
  FROM judged),
rated AS (
  SELECT s.*, t.z::BIGINT AS source_size, t.target,
         CASE WHEN t.z > 0 THEN t.target / t.z::DOUBLE ELSE 1.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 8))::BIGINT
           / 4294967296.0::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM rated
"""
