"""Toxicity: a convolutional text classifier.

Words hash to embeddings; filters of several widths slide over the whole text,
each keeping its largest response, and a logistic layer weighs these. It is
trained in numpy on a bounded sample of labelled documents. All others that are
labelled and not held out, of any length and number, are scored in Spark and
counted by language, label and score; each count stands for its share of all
labelled documents of its language and label, so the mix of the classes is
theirs at every size. These counts calibrate the scores so that 0.5 parts the
classes best, and a threshold for every language with enough positives.

Defined results: null and empty texts are scored as empty; equal texts have
equal scores; without labels of both classes every score is 0 and nothing is
rejected; an empty table gives no rows; other columns pass through."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespanel.llm.common import broadcast_if_small, give_back, keep_columns, shielded, table, written
from salespanel.llm.labelled import given, is_held_out, sample

SAMPLE_PER_CLASS = 5000
#: Characters of the sampled texts of a class, all together.
SAMPLE_CHARS = 16_000_000
BUCKETS = 1 << 20
WIDTHS = (1, 2, 3)
FILTERS = 8
EMBEDDING = 8
#: Buckets of a word: itself and two beginnings, so that unseen forms of a stem are known by it.
PARTS = 3
#: Passes over the sample; small samples are passed more often, up to STEPS rows in all.
EPOCHS, STEPS = 8, 20_000
THRESHOLD = 0.5
#: A language has its own threshold from so many calibration positives on.
LANGUAGE_POSITIVES = 15
#: Words handled at once; longer texts go block by block, overlapping by the widest filter.
BLOCK = 1 << 15
#: Margins are counted in bins of 1 / FINE.
FINE = 256
_EDGE = b".,;:!?\"'()[]{}|*%&$#-"


class _Buckets(dict):
    """word -> row of ``ids``, remembering up to ``SIZE`` words: the buckets of
    the word and of its first 4 and 6 bytes. Bucket 0 is the padding."""

    SIZE = 300_000

    def __init__(self):
        super().__init__()
        self.ids = np.zeros((self.SIZE, PARTS), np.int32)

    def __missing__(self, word: bytes) -> int:
        core = word.strip(_EDGE)
        row = self[word] = len(self)
        self.ids[row] = [1 + xxhash.xxh3_64_intdigest(x, seed) % (BUCKETS - 1) if core else 0
                         for seed, x in enumerate((core, core[:4], core[:6]))]
        return row


def tokens(text: str | None, buckets: _Buckets) -> np.ndarray:
    """Bucket rows of a whole text's words, padded at its end."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = []
    for at in range(0, len(words), BLOCK):
        if len(buckets) + BLOCK > buckets.SIZE:
            buckets.clear()
        part = words[at:at + BLOCK]
        out.append(buckets.ids[np.fromiter(map(buckets.__getitem__, part), np.int64, len(part))])
    return np.concatenate([*out, np.zeros((max(WIDTHS), PARTS), np.int32)])


def _embedded(e: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return sum(e[ids[:, p]].astype(np.float32) for p in range(PARTS))


def _responses(m: dict, x: np.ndarray, k: int) -> np.ndarray:
    """Filters of the k-th width at every position of an embedded text."""
    width, n = WIDTHS[k], len(x) - max(WIDTHS) + 1
    return sum(x[j:j + n] @ m["f"][k][j] for j in range(width)) + m["b"][k]


def pooled(m: dict, ids: np.ndarray) -> np.ndarray:
    best = np.full(len(WIDTHS) * FILTERS, -np.inf, np.float32)
    for start in range(0, max(1, len(ids) - max(WIDTHS) + 1), BLOCK):
        x = _embedded(m["e"], ids[start:start + BLOCK + max(WIDTHS) - 1])
        best = np.maximum(best, np.concatenate([_responses(m, x, k).max(0) for k in range(len(WIDTHS))]))
    return np.maximum(best, 0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def margins(m: dict, docs: Iterable[np.ndarray]) -> np.ndarray:
    """``docs`` may be a generator, so that one text's rows are held at a time."""
    return np.array([pooled(m, d) @ m["u"] + m["c"] for d in docs])


def fit(docs: list[np.ndarray], y: np.ndarray, seed: int = 11) -> dict:
    """Weights by minibatches with per-weight step sizes; only the positions
    that won the pooling learn. ``docs`` is emptied, as it is most of the memory."""
    rng = np.random.default_rng(seed)
    seen = np.zeros(BUCKETS, np.int32)
    for d in docs:
        seen[np.unique(d)] += 1
    seen[0] = 0
    known = np.flatnonzero(seen >= 2)
    del seen
    small = np.zeros(BUCKETS, np.int32)  # bucket -> row of the trained embeddings; 0: none
    small[known] = np.arange(1, len(known) + 1)
    docs.reverse()
    rows = [small[docs.pop()] for _ in range(len(docs))]
    e = np.concatenate([np.zeros((1, EMBEDDING)), rng.normal(0, 0.1, (len(known), EMBEDDING))]).astype(np.float32)
    m = {"e": e, "f": [rng.normal(0, 0.3, (w, EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS],
         "b": [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
         "u": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "c": 0.0}
    state: dict = {}

    def step(key, value, grad, rate, where=slice(None)):
        g = state.setdefault(key, np.full(np.shape(value), 1e-6, np.float32))
        g[where] += grad ** 2
        value[where] -= rate * grad / np.sqrt(g[where])

    bias = np.zeros(1, np.float32)
    balance = np.where(y == 1, np.sqrt(max(1.0, (y == 0).sum() / max(1, (y == 1).sum()))), 1.0)
    for _ in range(max(EPOCHS, min(60, STEPS // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 32):
            part = order[at:at + 32]
            text = np.concatenate([rows[i] for i in part])
            ends = np.cumsum([len(rows[i]) for i in part])
            starts = np.concatenate([[0], ends[:-1]])
            x = _embedded(m["e"], text)
            x = np.concatenate([x, np.zeros((max(WIDTHS), EMBEDDING), np.float32)])
            tops, wins = [], []
            for k in range(len(WIDTHS)):
                r = _responses(m, x, k)
                won = np.stack([s + r[s:t - max(WIDTHS) + 1].argmax(0) if t - max(WIDTHS) + 1 > s else np.full(FILTERS, s)
                                for s, t in zip(starts, ends, strict=True)])
                wins.append(won)
                tops.append(np.take_along_axis(r, won, 0))
            h = np.maximum(np.concatenate(tops, 1), 0)
            err = ((_sigmoid(h @ m["u"] + bias[0]) - y[part]) * balance[part] / len(part)).astype(np.float32)
            dh = err[:, None] * m["u"] * (h > 0)
            ids, grads = [], []
            padded = np.concatenate([text, np.zeros((max(WIDTHS), PARTS), text.dtype)])
            for k, w in enumerate(WIDTHS):
                g = dh[:, k * FILTERS:(k + 1) * FILTERS]
                df = np.zeros_like(m["f"][k])
                for j in range(w):
                    pos = wins[k] + j
                    df[j] = np.einsum("bf,bfe->ef", g, x[pos])
                    grad = (g[:, :, None] * m["f"][k][j].T[None]).reshape(-1, EMBEDDING)
                    for p in range(PARTS):
                        ids.append(padded[pos, p].ravel())
                        grads.append(grad)
                step(("f", k), m["f"][k], df + 1e-5 * m["f"][k], 0.05)
                step(("b", k), m["b"][k], g.sum(0), 0.05)
            ids, grads = np.concatenate(ids), np.concatenate(grads)
            used, where = np.unique(ids, return_inverse=True)
            total = np.stack([np.bincount(where, grads[:, j], len(used)) for j in range(EMBEDDING)], 1).astype(np.float32)
            total[used == 0] = 0
            step("e", m["e"], total, 0.1, used)
            m["e"][0] = 0
            step("u", m["u"], err @ h + 1e-4 * m["u"], 0.05)
            step("c", bias, np.array([err.sum()], np.float32), 0.05)
    return m | {"e": m["e"][1:].astype(np.float16), "known": known, "c": float(bias[0])}


def ready(m: dict) -> dict:
    """The model with a row of embeddings for every bucket; it travels with those of known buckets only."""
    full = np.zeros((BUCKETS, EMBEDDING), np.float16)
    full[m["known"]] = m["e"]
    return m | {"e": full}


def stored_model(m: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, e=m["e"], known=m["known"], u=m["u"], c=m["c"], **{f"f{k}": f for k, f in enumerate(m["f"])},
             **{f"b{k}": b for k, b in enumerate(m["b"])})
    return out.getvalue()


def read_model(data: bytes) -> dict:
    a = np.load(io.BytesIO(data))
    return {"e": a["e"], "known": a["known"], "u": a["u"], "c": float(a["c"]),
            "f": [a[f"f{k}"] for k in range(len(WIDTHS))], "b": [a[f"b{k}"] for k in range(len(WIDTHS))]}


def _best_threshold(bins: np.ndarray, weight: np.ndarray, y: np.ndarray) -> float:
    """The margin that parts the classes with the best F1, midway between two
    bins; rows are (bin of margins, weight, label)."""
    one, where = np.unique(-bins, return_inverse=True)  # the highest first
    all_, hit = np.bincount(where, weight), np.bincount(where, weight * y)
    f1 = 2 * np.cumsum(hit) / (np.cumsum(all_) + hit.sum())
    at = int(f1.argmax())
    low = -one[at] / FINE
    return float((low + (1 - one[at + 1]) / FINE) / 2) if at + 1 < len(one) else float(low - 1)


def calibration(docs: DataFrame, labels: DataFrame, model: dict, fitted: list[int]) -> pd.DataFrame:
    """(lang, label, bin, n, weight, overall): how many labelled documents,
    neither held out nor fitted on, have a margin in each bin; weights sum to
    the numbers of all labelled documents of a language and label, the fitted
    ones too, and overall weights to those of a label. Of repeated rows of an
    id one counts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("long")
    def bin_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets, m = _Buckets(), ready(shared.value)
        for texts in parts:
            texts = texts.where(texts.notna(), None)
            yield pd.Series(np.floor(margins(m, (tokens(t, buckets) for t in texts)) * FINE).astype(np.int64))
        del buckets, m
        give_back()

    known = spark.createDataFrame([(i,) for i in fitted], "doc_id long").withColumn("fitted", F.lit(True))
    marked = written(spark, given(labels, "toxic").join(F.broadcast(known), "doc_id", "left"), "toxicity-labels")
    own = keep_columns(docs, {"doc_id": "long", "text": "string", "lang": "string"}).join(broadcast_if_small(marked, 16), "doc_id")
    # a fitted document is counted, not scored
    scored = own.withColumn("text", F.when(F.col("fitted").isNull(), F.col("text"))).withColumn("bin", bin_of("text")).select(
        "doc_id", "label", "fitted", F.struct(F.xxhash64("text").alias("h"), "lang", "bin").alias("row"))
    rows = scored.groupBy("doc_id", "label", "fitted").agg(F.min("row").alias("row")).groupBy(
        F.col("row.lang").alias("lang"), "label", F.col("fitted").isNull().alias("free"), F.col("row.bin").alias("bin")).agg(
        F.count("*").alias("n")).toPandas()
    shared.destroy()
    rows["lang"] = rows["lang"].astype(object).where(rows["lang"].notna(), None)
    rows["of"] = [(x is not None, x or "", y) for x, y in zip(rows["lang"], rows["label"], strict=True)]
    free = rows[rows["free"]].copy()
    free["weight"] = free["n"] * free["of"].map(rows.groupby("of")["n"].sum() / free.groupby("of")["n"].sum())
    # languages of which all of a label was fitted on are made up for by the others
    free["overall"] = free["weight"] * free["label"].map(rows.groupby("label")["n"].sum() / free.groupby("label")["weight"].sum())
    return free.sort_values(["bin", "label"], kind="stable")[["lang", "label", "bin", "n", "weight", "overall"]].reset_index(drop=True)


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weights learned from the sample, in one task (the sample is
    bounded) and in the order of its rows, and the ids they were fitted on;
    nothing without both classes. Of the texts only their rows are kept."""
    buckets, docs, y, used = _Buckets(), [], [], []
    met = {0: 0, 1: 0}
    for b in batches:
        for doc_id, text, label in zip(*[b.column(c) for c in ("doc_id", "text", "label")], strict=True):
            label = label.as_py()
            met[label] += 1
            if met[label] % 5:  # every fifth document of a class is left to calibrate
                docs.append(tokens(text.as_py(), buckets))
                y.append(label)
                used.append(doc_id.as_py())
    del buckets
    if not all(met.values()):
        return
    give_back()
    m = fit(docs, np.array(y, float))
    yield pa.RecordBatch.from_pylist([{"model": stored_model(m), "fitted": sorted(set(used))}],
                                     pa.schema([("model", pa.binary()), ("fitted", pa.list_(pa.int64()))]))
    del m
    give_back()


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> dict | None:
    """The model, calibrated: margins are shifted so that 0 (a score of 0.5)
    parts the classes; ``by_lang`` has the languages' own score thresholds."""
    rows = sample(docs, labels, "toxic", per_class, SAMPLE_CHARS).select("doc_id", "text", "label")
    rows = rows.repartition(1).sortWithinPartitions("doc_id", "text")
    done = written(docs.sparkSession, rows.mapInArrow(_fitted, "model binary, fitted array<long>"), "toxicity-fit").first()
    if done is None:
        return None
    m = read_model(bytes(done.model))
    got = calibration(docs, labels, m, done.fitted)
    bins, weight, y = (got[x].to_numpy() for x in ("bin", "weight", "label"))
    if not 0 < y.sum() < len(y):
        return m | {"by_lang": {}}
    shift = _best_threshold(bins, got["overall"].to_numpy(), y)
    m["c"] -= shift
    by_lang = {}
    for one in sorted({x for x in got["lang"] if isinstance(x, str)}):
        own = (got["lang"] == one).to_numpy()
        if got["n"].to_numpy()[own & (y == 1)].sum() >= LANGUAGE_POSITIVES and (y[own] == 0).any():
            by_lang[one] = float(_sigmoid(_best_threshold(bins[own], weight[own], y[own]) - shift))
    return m | {"by_lang": by_lang}


def predict(m: dict | None, texts) -> np.ndarray:
    if m is None:
        return np.zeros(len(texts))
    buckets = _Buckets()
    return _sigmoid(margins(ready(m), (tokens(t, buckets) for t in texts)))


@shielded("text")
def with_toxicity(docs: DataFrame, model: dict | None, column: str = "_toxicity") -> DataFrame:
    """``docs`` and a column with the chance that a document is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets, m = _Buckets(), ready(shared.value) if shared.value else None
        for texts in parts:
            texts = texts.where(texts.notna(), None)
            yield pd.Series(_sigmoid(margins(m, (tokens(t, buckets) for t in texts))) if m else np.zeros(len(texts)), dtype=float)
        del buckets, m
        give_back()

    return docs.withColumn(column, score(F.col("text")))


def threshold(model: dict | None, lang):
    """The rejecting score by language: its own one, or 0.5."""
    out = F.lit(THRESHOLD)
    for name, value in ((model or {}).get("by_lang") or {}).items():
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out


@shielded("text", "lang")
def not_toxic(docs: DataFrame, model: dict | None) -> DataFrame:
    """The documents under the threshold of their language, in the columns of ``docs``."""
    scored = with_toxicity(docs, model)
    return scored.where(F.col("_toxicity") < threshold(model, F.col("lang"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = with_toxicity(keep_columns(docs, {"doc_id": "long", "text": "string", "lang": "string"}), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"),
                         (F.col("_toxicity") >= THRESHOLD).cast("int").alias("predicted"),
                         (F.col("_toxicity") >= threshold(model, F.col("lang"))).alias("rejected"))
