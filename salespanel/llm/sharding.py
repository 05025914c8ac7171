"""Sharding by extendible hashing.

Documents hash to 64 bits. A directory indexed by the first bits of that hash
names each document's bucket; a bucket over the byte limit splits on one more
bit, alone, until it fits. Byte sums of the prefixes decide all splits of
several levels at once; buckets that are still too large at the deepest of
these levels go on in a further round, so no depth is cut off.

Defined results: a null text has 0 bytes and is kept; a single document above
the limit has a shard of its own; equal rows (same id and text) share a hash
that no bit can split and are dealt out into numbered parts of that shard; an
empty table gives no rows; other columns pass through untouched, but for those
named like the three new ones, which are replaced."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salespanel.llm.common import broadcast_if_small, keep_columns, shielded, table, written

LIMIT_BYTES = 32 * 1024 * 1024
#: Bits looked at below the level that an even spread would need.
SPARE_BITS = 4
HASH_BITS = 64


def _prefix(hash_column, bits: int):
    """The first ``bits`` bits of a hash; Java shifts by 64 as by 0."""
    return F.shiftrightunsigned(hash_column, HASH_BITS - bits) if bits else F.lit(0).cast("long")


def _cells(keys: DataFrame, base: int, depth: int) -> DataFrame:
    """cell (prefix of ``depth`` bits) -> the shallowest prefix of at least
    ``base`` bits that fits: columns _cell, _depth, _bytes, _rows (null depth: none fits)."""
    cells = keys.groupBy(_prefix(F.col("_hash"), depth).alias("_cell")).agg(
        F.sum("_size").alias("bytes"), F.count("*").alias("rows"),
        F.min("_hash").alias("lo"), F.max("_hash").alias("hi"))
    at = cells.withColumn("level", F.explode(F.sequence(F.lit(base), F.lit(depth)))).withColumn(
        "node", F.expr(f"if(level = 0, 0L, shiftrightunsigned(_cell, {depth} - level))"))
    return at


def _fitting(at: DataFrame, limit: int) -> DataFrame:
    nodes = at.groupBy("level", "node").agg(
        F.sum("bytes").alias("_bytes"), F.sum("rows").alias("_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    fits = nodes.where((F.col("_bytes") <= limit) | (F.col("lo") == F.col("hi"))).drop("lo", "hi")
    own = at.select("_cell", "level", "node").join(fits, ["level", "node"])
    return own.groupBy("_cell").agg(F.min(F.struct("level", "_bytes", "_rows")).alias("leaf")).select(
        "_cell", F.col("leaf.level").alias("_depth"), F.col("leaf._bytes").alias("_bytes"),
        F.col("leaf._rows").alias("_rows"))


@shielded("doc_id", "text")
def sharded(docs: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """``docs`` and the columns shard (prefix bits), shard_depth and shard_bytes."""
    spark = docs.sparkSession
    own = docs.withColumn("_hash", F.xxhash64(F.col("doc_id"), F.col("text"))).withColumn(
        "_size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    keys = written(spark, own.select("_hash", "_size"), "shard-keys")
    total = keys.agg(F.sum("_size")).first()[0] or 0
    step = max(1, math.ceil(math.log2(max(1.0, total / limit))) + SPARE_BITS)
    base, depth, rest, done, crowds = 0, min(step, HASH_BITS), own, [], False
    crowded = (F.col("_bytes") > limit) & (F.col("_rows") > 1)
    while True:
        directory = written(spark, _fitting(_cells(keys, base, depth), limit), "shard-directory")
        crowds = crowds or not directory.where(crowded).isEmpty()
        known = rest.withColumn("_cell", _prefix(F.col("_hash"), depth)).join(
            broadcast_if_small(directory, 40), "_cell", "left")
        done.append(known.where(F.col("_depth").isNotNull()).drop("_cell"))
        pending = keys.withColumn("_cell", _prefix(F.col("_hash"), depth)).join(
            broadcast_if_small(directory, 40), "_cell", "left_anti").drop("_cell")
        if depth == HASH_BITS or pending.isEmpty():
            break
        keys = written(spark, pending, "shard-keys")
        rest = known.where(F.col("_depth").isNull()).drop("_cell", "_depth", "_bytes", "_rows")
        base, depth = depth + 1, min(HASH_BITS, depth + step)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.expr(f"if(_depth = 0, '', lpad(bin(shiftrightunsigned(_hash, {HASH_BITS} - _depth)), cast(_depth as int), '0'))")
    out = out.withColumn("shard", F.concat(F.lit("s"), bits))
    # only buckets of one hash are over the limit here; those of several rows are dealt into parts
    turn = F.row_number().over(Window.partitionBy("_hash").orderBy("_size")) - 1
    fit = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(limit) / F.greatest(F.col("_size"), F.lit(1).cast("long"))))
    shown = [F.col(f"`{c}`") for c in docs.columns if c not in ("shard", "shard_depth", "shard_bytes")]
    plain = out.where(~crowded).select(*shown, "shard", F.col("_depth").alias("shard_depth"), F.col("_bytes").alias("shard_bytes"))
    if crowds:
        parted = out.where(crowded).withColumn("_part", F.floor(turn / fit)).withColumn(
            "shard", F.concat("shard", F.lit("."), F.col("_part").cast("string")))
        one = Window.partitionBy("_hash", "_part")
        plain = plain.unionByName(parted.select(*shown, "shard", F.col("_depth").alias("shard_depth"),
                                                F.sum("_size").over(one).alias("shard_bytes")))
    return plain


def query(spark, sf_dir) -> DataFrame:
    docs = keep_columns(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string"})
    return sharded(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                                "shard", "shard_depth", "shard_bytes")
