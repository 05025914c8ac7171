"""Substring dedup: words covered by passages that occur more than once.

A window is 35 consecutive words; every word covered by a window whose words
also start elsewhere goes. The work is shared out by content, in two sieves,
so that no document is compared with another and no index of the corpus is
held anywhere:

1. Of a window's 8-word runs the one with the smallest hash is its anchor;
   equal windows have equal anchors, and an anchor serves a dozen windows on
   average. Windows whose anchor is met once in the corpus are done with.
2. The other windows are dealt out by a hash of all their words; those met
   more than once are repeated. Runs of equal keys are read in order and never
   held, however often a passage occurs.

Repeated windows of a document merge into spans, and the spans' words go.

Defined results: a null, empty or wordless text has no words; texts of fewer
than 35 words lose nothing; rows that are equal, id and all, are occurrences
of their own; an empty table gives no rows; other columns pass through
untouched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespanel.llm.common import (
    BROADCAST_BYTES,
    give_back,
    keep_columns,
    mix,
    shielded,
    table,
    window_hashes,
    word_hashes,
    words_of,
    written,
)

WINDOW = 35
ANCHOR = 8
#: Rows that a task gathers before it passes them on, about.
BATCH_ROWS = 1 << 18


def _hashes(text: str | None) -> np.ndarray:
    words = words_of(text)
    return word_hashes(words, len(words))


def anchors_of(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hashes of a text's windows, each with the first window and the
    number of windows that it serves in a row."""
    if len(h) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)
    runs = mix(window_hashes(h, anchor))
    per = window - anchor + 1
    at = np.lib.stride_tricks.sliding_window_view(runs, per).argmin(1) + np.arange(len(h) - window + 1)
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return runs[at[starts]], starts.astype(np.int32), np.diff(np.append(starts, len(at))).astype(np.int32)


class _Rows:
    """Rows (h, k, start, n) gathered until there are some BATCH_ROWS of them."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, h: np.ndarray, key: int, start: np.ndarray, n: np.ndarray) -> bool:
        """Whether there are enough for a batch."""
        self.parts.append((h.view(np.int64), np.full(len(h), key, np.int64), start, n))
        self.size += len(h)
        return self.size >= BATCH_ROWS

    def batch(self) -> pa.RecordBatch:
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
        columns = [pa.array(np.concatenate(c)) for c in zip(none, *self.parts, strict=True)]
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays(columns, ["h", "k", "start", "n"])


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """(h, k, start, n): an anchor of the document with key k, its first window and number of windows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _Rows()
            for key, text in zip(b.column("k").to_numpy(), b.column("text").to_pylist(), strict=True):
                a, s, m = anchors_of(_hashes(text), window)
                if out.add(a, key, s, m):
                    yield out.batch()
            yield out.batch()
        give_back()

    return docs.mapInArrow(emit, "h long, k long, start int, n int")


def _met_again(rows: DataFrame) -> DataFrame:
    """The rows (h, k, start, n) whose h another row has too, as (k, start, n).
    Rows lie together by h; a task reads them in order and holds one row back."""
    together = rows.repartition("h").sortWithinPartitions("h")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, None  # the last row read, and the key before it
        for b in batches:
            if held is not None:
                b = pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            h = b.column("h").to_numpy()
            if not len(h):
                continue
            same = np.zeros(len(h), bool)
            same[1:] = h[1:] == h[:-1]
            same[:-1] |= same[1:]
            if before is not None:
                same[0] |= h[0] == before
            if len(h) > 1:
                before = h[-2]
            held = b.slice(len(h) - 1)
            yield b.slice(0, len(h) - 1).filter(pa.array(same[:-1])).select(["k", "start", "n"])
        if held is not None and before is not None and held.column("h").to_numpy()[0] == before:
            yield held.select(["k", "start", "n"])
        give_back()

    return together.mapInArrow(again, "k long, start int, n int")


def _spans(rows: DataFrame, name: str) -> DataFrame:
    """(k, starts, ends) with the rows' ranges of each document merged; broadcast if it is small."""
    spark = rows.sparkSession
    per = rows.groupBy("k").agg(F.collect_list("start").alias("start"), F.collect_list("n").alias("n"))

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            starts, ends = [], []
            for s, n in zip(x["start"], x["n"], strict=True):
                order = np.argsort(s, kind="stable")
                s, e = s[order].astype(np.int64), np.maximum.accumulate((s + n)[order].astype(np.int64))
                first = np.concatenate([[True], s[1:] > e[:-1]])
                starts.append(s[first])
                ends.append(e[np.append(np.flatnonzero(first)[1:] - 1, len(e) - 1)])
            yield pd.DataFrame({"k": x["k"], "starts": starts, "ends": ends})

    out = written(spark, per.mapInPandas(merge, "k long, starts array<int>, ends array<int>"), name)
    n, spans = out.agg(F.count("*"), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
    return F.broadcast(out) if 64 * n + 16 * spans <= BROADCAST_BYTES else out


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(h, k, start, n = 1) of the windows in the given ranges of each document."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = _Rows()
            ranges = zip(b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True)
            for key, text, (s, e) in zip(b.column("k").to_numpy(), b.column("text").to_pylist(), ranges, strict=True):
                words = _hashes(text)
                for i, j in zip(s, e, strict=True):
                    own = window_hashes(words[i:j + window - 1], window)
                    if out.add(own, key, np.arange(i, i + len(own), dtype=np.int32), np.ones(len(own), np.int32)):
                        yield out.batch()
            yield out.batch()
        give_back()

    return docs.mapInArrow(emit, "h long, k long, start int, n int")


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k, starts, ends): runs of repeated windows, numbered by their first
    words, of the document with key k (see ``document_key``)."""
    own = keep_columns(docs, {"doc_id": "long", "text": "string"}).select(document_key().alias("k"), "text")
    maybe = _spans(_met_again(_anchors(own, window)), "substring-candidates")
    return _spans(_met_again(_windows(own.join(maybe, "k"), window)), "substring-spans")


def document_key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


@shielded("doc_id", "text")
def with_kept(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` and _kept (kept words joined by a space), _n_words and _n_removed."""
    spans = repeated_spans(docs, window)

    @F.pandas_udf("kept string, n_words long, n_removed long")
    def cut(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, starts, ends in parts:
            rows = []
            for text, s, e in zip(texts, starts, ends, strict=True):
                words = words_of(text)
                n = len(words)
                if s is not None:
                    keep = np.ones(n, bool)
                    for i, j in zip(s, e, strict=True):
                        keep[i:j + window - 1] = False
                    words = [words[i] for i in np.flatnonzero(keep)]
                rows.append((b" ".join(words).decode("utf-8", "surrogatepass"), n, n - len(words)))
            yield pd.DataFrame(rows, columns=["kept", "n_words", "n_removed"])
        give_back()

    out = docs.withColumn("_k", document_key()).join(
        spans.select(F.col("k").alias("_k"), F.col("starts").alias("_starts"), F.col("ends").alias("_ends")), "_k", "left")
    out = out.withColumn("_cut", cut(F.col("text"), F.col("_starts"), F.col("_ends")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_cut.kept").alias("_kept"),
                      F.col("_cut.n_words").alias("_n_words"), F.col("_cut.n_removed").alias("_n_removed"))


def query(spark, sf_dir) -> DataFrame:
    docs = keep_columns(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string"})
    return with_kept(docs).select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"),
                                  F.sha2(F.col("_kept"), 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM d, unnest(range(1, len(w) - 33)) t(i)),
again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT r, i + j AS pos FROM windows JOIN again USING (k), unnest(range(0, 35)) u(j)),
words AS (
  SELECT r, i AS pos, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) t(i)),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (r, pos) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
