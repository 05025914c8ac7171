"""Document fingerprints: bottom-k sketches of word shingles.

A sketch is the k smallest distinct 48-bit hashes of a text's five-word
shingles, in order. Sketches of parts merge into the sketch of the whole;
two of them estimate resemblance and containment, one the number of distinct
shingles. All of it is DataFrame code.

Defined results: letters are compared in lower case; a text of fewer than five
words is one shingle; a null, empty or wordless text has the empty sketch,
which is like another empty one (1.0) and unlike any other (0.0); equal rows
have equal sketches; documents without id come last, and documents with the
same id follow each other by text; other columns don't matter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespanel.llm.common import WORD_GAP, bound, keep_columns, table

K = 128
SHINGLE = 5
HASH_BITS = 48
#: Rows that a bucket of consecutive ids should hold, and the most buckets.
BUCKET_ROWS, MAX_BUCKETS = 1024, 4096


def shingle_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def _shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    cut = lambda h: F.shiftrightunsigned(h, 64 - HASH_BITS)
    many = F.transform(F.sequence(F.lit(0), F.size(words) - size),
                       lambda i: cut(F.xxhash64(*[F.get(words, i + k) for k in range(size)])))
    return F.when(F.size(words) >= size, many).when(F.size(words) > 0, F.array(cut(F.xxhash64(words)))).otherwise(
        F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, size: int = SHINGLE) -> DataFrame:
    """``df`` and the sketch of a text column."""
    return df.withColumn(name, bottom(bound(shingle_words(F.col(text)), lambda w: _shingle_hashes(w, size)), k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of two shingle sets."""
    return bottom(F.concat(a, b), k)


def merged(parts: DataFrame, key: str, sketch: str = "sketch", k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per key from the sketches of its parts; a key with many parts merges salted first."""
    unite = bottom(F.flatten(F.collect_list(sketch)), k).alias(sketch)
    salted = parts.select(F.col(key), F.col(sketch), F.pmod(F.xxhash64(F.col(sketch)), F.lit(salts)).alias("_salt"))
    return (salted.distinct().groupBy(key, "_salt").agg(unite).groupBy(key).agg(unite))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's sketch that both hold."""
    union = bottom(F.concat(a, b), k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    top = F.element_at(a, -1) + 1
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1) * 2.0 ** HASH_BITS) / top)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    j, na, nb = resemblance(a, b, k), distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def as_text(sketch: Column) -> Column:
    """A sketch as text: twelve hexadecimal digits a hash, in order."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), HASH_BITS // 4, "0")), ""))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """(doc_id, text, ...) and, as next_<column>, the carried columns of the
    next document by ascending id; the last one's next is the first.

    Ids fall into buckets between quantiles of themselves, each ordered on its
    own; the first document of each bucket is also sent to the bucket before,
    to stand behind its last one. One shuffle, and no order over all rows."""
    o = F.coalesce(F.col("doc_id"), F.lit(2 ** 63 - 1))
    n = docs.select("doc_id").count()
    buckets = min(MAX_BUCKETS, max(1, math.ceil(n / BUCKET_ROWS)))
    bounds = []
    if buckets > 1:
        got = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
        bounds = sorted(set(got or []))
    edges = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.array().cast("array<bigint>")
    d = docs.withColumn("_o", o).withColumn("_bucket", F.size(F.filter(edges, lambda e: e < F.col("_o"))))
    firsts = dict(d.groupBy("_bucket").agg(F.min("_o")).collect())  # at most MAX_BUCKETS rows
    if not firsts:
        firsts = {0: 0}
    held = sorted(firsts)
    before = {b: held[i - 1] for i, b in enumerate(held)}
    first = F.array(*[F.lit(firsts.get(b)).cast("long") for b in range(len(bounds) + 1)])
    prior = F.array(*[F.lit(before.get(b)).cast("int") for b in range(len(bounds) + 1)])
    leads = F.col("_o") == F.get(first, F.col("_bucket"))
    here = F.struct(F.col("_bucket").cast("int").alias("at"), F.lit(0).alias("guest"))
    there = F.struct(F.get(prior, F.col("_bucket")).alias("at"), F.lit(1).alias("guest"))
    d = d.withColumn("_place", F.explode(F.when(leads, F.array(here, there)).otherwise(F.array(here))))
    names = docs.columns
    # plain columns, so that one exchange and one sort serve all that is carried
    d = d.select(*names, "_o", F.col("_place.at").alias("_at"), F.col("_place.guest").alias("_guest"))
    order = Window.partitionBy("_at").orderBy("_guest", "_o", "text")
    d = d.select(*names, "_guest", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return d.where(F.col("_guest") == 0).drop("_guest")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text and sketch of every document."""
    own = keep_columns(docs, {"doc_id": "long", "text": "string"}).withColumn("text", F.coalesce("text", F.lit("")))
    return with_sketch(own, "text", "sketch", k)


def query(spark, sf_dir) -> DataFrame:
    docs = with_next(fingerprints(table(spark, sf_dir, "documents")), ["text", "sketch"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(
        F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    docs = with_sketch(docs, "edited", "edited_sketch")
    return docs.select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
