"""Benchmark decontamination with a broadcast hash set of n-grams.

Test items are normalised to words and cut into windows of ten (an item of
fewer words is one window); the set of their hashes is broadcast after a check
of its size, or joined by shuffle beyond it. Training documents stream their
word windows against it, the few hits are verified word by word, and hit words
or whole documents are removed. All of it is DataFrame code.

Defined results: a null or wordless text has no words and is clean; a null or
wordless item has no window; an item without id counts as hits but isn't
listed; rows that are equal in id and text are each reported; an empty
benchmark leaves everything clean; other columns pass through untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salespanel.llm.common import bound, broadcast_if_small, keep_columns, shielded, table, written

WINDOW = 10
#: ASCII characters that part words once A-Z is in lower case; the second form is for text as it stands.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; ASCII texts take the quick function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def item_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), "")


def _window_hashes(words: Column, size: int) -> Column:
    """Structs (at, size, hash) of every run of ``size`` words."""
    at = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, F.transform(at, lambda i: F.struct(
        i.alias("at"), F.lit(size).alias("size"),
        F.xxhash64(*[F.get(words, i + k) for k in range(size)]).alias("hash")))).otherwise(
        F.array().cast("array<struct<at:int,size:int,hash:bigint>>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: size, hash, words, and the ids of the items that hold them."""
    items = keep_columns(benchmark, {"item_id": "string", "text": "string"}).withColumn(
        "words", item_words(F.col("text"))).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    cut = items.withColumn("size", size).withColumn(
        "at", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size")))).select(
        "item_id", "size", F.slice("words", F.col("at") + 1, F.col("size")).alias("words"))
    return cut.groupBy("size", "words").agg(F.collect_set("item_id").alias("items")).withColumn(
        "hash", _hash_of("words", window))


def _hash_of(words: str, window: int) -> Column:
    """The scan's hash of a whole array of at most ``window`` words."""
    out = F.lit(None).cast("long")
    for n in range(1, window + 1):
        out = F.when(F.size(words) == n, F.xxhash64(*[F.get(words, F.lit(k)) for k in range(n)])).otherwise(out)
    return out


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents with a verified hit, one row per distinct (doc_id, text):
    _id, _text_hash, words, covered (0-based positions of hit words) and items (sorted ids)."""
    spark = docs.sparkSession
    windows = written(spark, benchmark_windows(benchmark, window), "benchmark-windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most ``window`` values
    own = keep_columns(docs, {"doc_id": "long", "text": "string"}).select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_hash"), "text")
    if not sizes:
        sizes = [window]
    cut = lambda words: F.concat(*[_window_hashes(words, n) for n in sizes])
    scanned = own.select("_id", "_text_hash", bound(item_words(F.col("text")), cut).alias("runs"))
    at = scanned.select("_id", "_text_hash", F.inline("runs"))
    found = at.join(broadcast_if_small(windows, 400).select("size", "hash"), ["size", "hash"]).groupBy(
        "_id", "_text_hash").agg(F.collect_set(F.struct("at", "size", "hash")).alias("found"))
    found = written(spark, found, "benchmark-hits")
    keys = broadcast_if_small(found.select("_id", "_text_hash"), 32)
    same = F.col("_id").eqNullSafe(F.col("k_id")) & (F.col("_text_hash") == F.col("k_hash"))
    texts = own.join(keys.select(F.col("_id").alias("k_id"), F.col("_text_hash").alias("k_hash")), same, "left_semi")
    texts = texts.dropDuplicates(["_id", "_text_hash"]).withColumn("words", item_words(F.col("text")))
    f = found.select(F.col("_id").alias("k_id"), F.col("_text_hash").alias("k_hash"), F.explode("found").alias("hit"))
    f = f.join(windows.select(F.col("size").alias("w_size"), F.col("hash").alias("w_hash"), F.col("words").alias("w_words"), "items"),
               (F.col("hit.size") == F.col("w_size")) & (F.col("hit.hash") == F.col("w_hash")))
    f = f.groupBy("k_id", "k_hash").agg(F.collect_list(F.struct("hit.at", "hit.size", "w_words", "items")).alias("hits"))
    checked = texts.join(f, same).withColumn("hits", F.filter(
        "hits", lambda h: F.slice(F.col("words"), h["at"] + 1, h["size"]) == h["w_words"])).where(F.size("hits") > 0)
    return checked.select(
        "_id", "_text_hash", "words",
        F.array_sort(F.array_distinct(F.flatten(F.transform(
            "hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))).alias("covered"),
        F.sort_array(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = written(docs.sparkSession, hits(docs, benchmark, window).select(
        F.col("_id").alias("k_id"), F.col("_text_hash").alias("k_hash"), F.size("covered").alias("hit"), "items"),
        "benchmark-report")
    own = keep_columns(docs, {"doc_id": "long", "text": "string"}).select(
        "doc_id", F.xxhash64("text").alias("_text_hash"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    out = own.join(found, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("_text_hash") == F.col("k_hash")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("hit") > 0, F.lit(False)).alias("contaminated"))


@shielded("doc_id", "text", "n_chars")
def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with
    their hit words and the gaps before these cut out of the text."""
    found = hits(docs, benchmark, window).select(
        F.col("_id").alias("k_id"), F.col("_text_hash").alias("k_hash"), "covered")
    found = broadcast_if_small(written(docs.sparkSession, found, "benchmark-found"), 512)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("k_id")) & (F.xxhash64(F.col("text")) == F.col("k_hash"))
    if remove == "documents":
        return docs.join(found, same, "left_anti")
    shown = [F.col(f"`{c}`") for c in docs.columns]
    hit = docs.join(found, same, "left")
    pieces = F.regexp_extract_all("text", F.lit(f"[{GAP_ANY_CASE}]*[^{GAP_ANY_CASE}]+"), 0)
    tail = F.regexp_extract("text", f"([{GAP_ANY_CASE}]*)\\z", 1)
    kept = F.concat(F.array_join(F.filter(F.transform(pieces, lambda p, i: F.when(
        F.array_contains(F.col("covered"), i), None).otherwise(p)), lambda p: p.isNotNull()), ""), tail)
    text = F.when(F.col("covered").isNull(), F.col("text")).otherwise(kept)
    return hit.select(*[text.alias("text") if c == "text" else F.when(F.col("covered").isNull(), F.col(f"`{c}`")).otherwise(
        F.char_length(text)).alias(c) if c == "n_chars" else s for c, s in zip(docs.columns, shown, strict=True)])


def query(spark, sf_dir) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
runs AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM d, (SELECT DISTINCT n FROM windows), unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT r, runs.n, i, item FROM runs JOIN windows USING (n, k)),
covered AS (SELECT r, count(DISTINCT i + j) AS n FROM hits, unnest(range(0, hits.n)) u(j) GROUP BY r),
items AS (
  SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hits GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""
