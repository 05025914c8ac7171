"""Quality classifier: a factorisation machine.

Features of a text are its hashed words (log counts at unit length), its
structure statistics and its length, each statistic as the bin it falls in.
The machine weighs every feature and, through a short vector each, every pair
of features; the sum over all pairs is had in linear time as half the square
of the sum less the sum of the squares. It learns in numpy from a bounded
sample of labelled documents and is broadcast for scoring. Its intercept is
set from the sample's odds of the classes to those of all training labels.

Defined results: null and empty texts are scored by their (zero) statistics;
equal texts have equal scores; with no label to learn from, every score is
0.5; with an empty table there are no rows; other columns pass through."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespanel.llm.common import keep_columns, shielded, table, words_of
from salespanel.llm.labelled import given, is_held_out, sample

SAMPLE_PER_CLASS = 4000
#: Characters of the sampled texts of a class, all together.
SAMPLE_CHARS = 30_000_000
BUCKETS = 1 << 14
BINS = 16
FACTORS = 8
EPOCHS = 12
THRESHOLD = 0.3
_SYMBOLS = b"%&$#*|~^<>{}[]=+_\\/@"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def _share(raw: bytes, of: bytes) -> float:
    return (len(raw) - len(raw.translate(None, of))) / max(1, len(raw))


def statistics(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    """Structure of a text: sizes, shares of kinds of characters, repetition of words and lines."""
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = Counter(w[-1:] for w in words)
    common = sum(c for _, c in counts.most_common(3))
    return [
        np.log1p(len(raw)), np.log1p(n), float(lengths.mean()), float(lengths.std()), float(lengths.max()),
        _share(raw, _SYMBOLS), _share(raw, _UPPER), _share(raw, _DIGITS), _share(raw, b"!?"), _share(raw, b".,;:"),
        len(raw.translate(None, bytes(range(128)))) / max(1, len(raw)),
        len(counts) / max(1, n), common / max(1, n), again / max(1, n),
        ends[b"."] / max(1, n), (ends[b"!"] + ends[b"?"]) / max(1, n),
        sum(c for e, c in ends.items() if e in _SYMBOLS and e) / max(1, n),
        np.log1p(len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
    ]


N_STATISTICS = len(statistics(b"", [], Counter()))


def features(text: str | None) -> tuple[list[float], np.ndarray, np.ndarray]:
    """Statistics, word buckets and word values (of unit length) of a whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    counts = Counter(words)
    n = len(counts)
    at = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) & (BUCKETS - 1) for w in counts), np.int64, n)
    value = np.log1p(np.fromiter(counts.values(), np.float64, n))
    norm = np.sqrt((value ** 2).sum())
    return statistics(raw, words, counts), at, value / norm if n else value


def _rows(stats: np.ndarray, edges: np.ndarray, at: list[np.ndarray], value: list[np.ndarray]):
    """Feature rows: one index per statistic (its bin) after the word buckets; starts of the rows."""
    idx, val = [], []
    step = np.arange(len(edges)) * BINS + BUCKETS
    for s, a, v in zip(stats, at, value, strict=True):
        idx += [step + [np.searchsorted(e, x) for e, x in zip(edges, s, strict=True)], a]
        val += [np.full(len(edges), 0.3), v]
    sizes = np.array([len(edges) + len(a) for a in at])
    return np.concatenate(idx), np.concatenate(val), np.concatenate([[0], np.cumsum(sizes)[:-1]])


def _margin(model: dict, idx: np.ndarray, val: np.ndarray, starts: np.ndarray):
    v = model["v"][idx] * val[:, None]
    total = np.add.reduceat(v, starts)
    pairs = 0.5 * (total ** 2 - np.add.reduceat(v ** 2, starts)).sum(1)
    return model["w0"] + np.add.reduceat(model["w"][idx] * val, starts) + pairs, total


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(texts: list[str | None], y: np.ndarray, seed: int = 7) -> dict | None:
    """The machine, by minibatches with per-weight step sizes; None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    got = [features(t) for t in texts]
    stats = np.array([g[0] for g in got])
    edges = np.array([np.quantile(stats[:, j], np.arange(1, BINS) / BINS) for j in range(stats.shape[1])])
    size = BUCKETS + BINS * len(edges)
    m = {"w0": 0.0, "w": np.zeros(size), "v": rng.normal(0, 0.05, (size, FACTORS)), "edges": edges}
    gw, gv, g0 = np.full(size, 1e-6), np.full((size, FACTORS), 1e-6), 1e-6
    rows = [_rows(stats[i:i + 1], edges, [got[i][1]], [got[i][2]])[:2] for i in range(len(y))]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(y))
        for b in range(0, len(y), 64):
            part = order[b:b + 64]
            idx = np.concatenate([rows[i][0] for i in part])
            val = np.concatenate([rows[i][1] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            margin, total = _margin(m, idx, val, starts)
            err = (_sigmoid(margin) - y[part]) / len(part)
            each = np.repeat(np.arange(len(part)), sizes)
            e = err[each] * val
            used, where = np.unique(idx, return_inverse=True)
            dw = np.bincount(where, e, len(used)) + 1e-5 * m["w"][used]
            one = e[:, None] * (total[each] - m["v"][idx] * val[:, None])
            dv = np.stack([np.bincount(where, one[:, f], len(used)) for f in range(FACTORS)], 1) + 1e-4 * m["v"][used]
            gw[used] += dw ** 2
            gv[used] += dv ** 2
            g0 += err.sum() ** 2
            m["w"][used] -= 0.2 * dw / np.sqrt(gw[used])
            m["v"][used] -= 0.02 * dv / np.sqrt(gv[used])
            m["w0"] -= 0.1 * err.sum() / np.sqrt(g0)
    return m


def predict(model: dict | None, texts) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    out = np.zeros(len(texts))
    for i, t in enumerate(texts):
        s, at, value = features(t)
        out[i] = _margin(model, *_rows(np.array([s]), model["edges"], [at], [value]))[0][0]
    return _sigmoid(out)


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict | None:
    rows = sample(docs, labels, "quality", per_class, SAMPLE_CHARS).select("text", "label").toPandas()
    rows = rows.sort_values(["label", "text"], na_position="first", kind="stable")
    y = rows["label"].to_numpy(float)
    model = fit(rows["text"].where(rows["text"].notna(), None).tolist(), y)
    if model is None:
        return None
    all_, good = given(labels, "quality").join(docs.select(F.col("doc_id").cast("long")), "doc_id", "left_semi").agg(
        F.count("*"), F.sum((F.col("label") == 1).cast("long"))).first()
    return model | {"w0": model["w0"] + float(np.log(good / (all_ - good)) - np.log(y.sum() / (len(y) - y.sum())))}


@shielded("text")
def with_quality(docs: DataFrame, model: dict | None, column: str = "_quality") -> DataFrame:
    """``docs`` and a column with the chance that a document is a good one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(predict(shared.value, texts.where(texts.notna(), None).tolist()))

    return docs.withColumn(column, score(F.col("text")))


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_quality(keep_columns(docs, {"doc_id": "long", "text": "string"}), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("_quality").alias("score"),
                         (F.col("_quality") >= THRESHOLD).cast("int").alias("predicted"))
