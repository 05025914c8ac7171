"""A bounded sample of labelled documents for the classifiers to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salespanel.llm.common import held_out, keep_columns

FOLDS, HELD_OUT_FOLD = 5, 0


def is_held_out(doc_id):
    return held_out(doc_id, FOLDS, HELD_OUT_FOLD)


def given(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) of every labelled document that is not held out. One
    with several labels counts as positive if one is; a null label is none."""
    return keep_columns(labels, {"doc_id": "long", label: "int"}).where(F.col(label).isNotNull()).where(
        ~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, chars: int) -> DataFrame:
    """(doc_id, text, lang, label) of at most ``per_class`` labelled documents a
    class, none held out, of any length, one row an id. They are taken in the
    order of a hash of the id until their texts have ``chars`` characters in
    all (the last one whole). Labels without a document don't count."""
    own = keep_columns(docs, {"doc_id": "long", "text": "string", "lang": "string"})
    labelled = given(labels, label).join(own.select("doc_id"), "doc_id", "left_semi")
    order = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    # at most 2 * per_class ids go out to the scan of the documents
    chosen = labelled.where(F.col("label") == 1).orderBy(order).limit(per_class).unionByName(
        labelled.where(F.col("label") == 0).orderBy(order).limit(per_class))
    # of an id's rows the one with the smallest hash of its text
    rows = own.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(
        F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("row")).select("doc_id", "row.text", "row.lang", "label")
    size = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    before = Window.partitionBy("label").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # over per_class rows at most
    return rows.withColumn("taken", F.coalesce(F.sum(size).over(before), F.lit(0))).where(F.col("taken") < chars).drop("taken")
