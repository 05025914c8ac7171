"""LM scoring: documents by a smoothed trigram model of words over the corpus.

Every word, pair and triple of the training documents counts; nothing is
lumped, pruned or capped. Each position (a word after its two before) goes to
the part of the model its middle word hashes to, where the training positions
make an Elias-Fano trie (see lm_trie) and all positions are scored by it. A
frequent middle word's positions are dealt over many parts by the word before,
so no part grows with one word; its pairs are then counted in a shuffle of
their own. The most frequent words go out to the tasks with their counts; the
parts ask for those of the others by hash range. Both only save traffic: no
score depends on which words they are.

What moves is packed: a chunk's positions, a range's answers (bare counts, in
the order of hashes that the part knows too) and the sums of a chunk's texts
are one row a part each, not one a position, word or text.

Absolute discounting: what the entries of a context leave goes to the shorter
context, at last to the words, of which all words never met are one more.

Defined results: a null or empty text is its end token; equal texts have equal
scores (sums are of whole numbers, so their order is nothing); a document
without id is held out; with no training document every word is unknown
(probability 1); an empty table gives no rows; other columns don't matter."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespanel.llm.common import held_out, keep_columns, mix, table, word_hashes, words_of, written
from salespanel.llm.lm_trie import PartTrie

FOLDS, HELD_OUT_FOLD = 7, 2
#: Words that go out to all tasks (24 bytes each); the counts of all others are asked for.
DICTIONARY = 500_000
#: Positions of a part, about; a middle word with more than HOT is dealt by the word before it too.
PART, HOT, LEAST_PARTS = 1_000_000, 1_000_000, 24
#: Positions a hash range of requests, about; the number of ranges is a power of two.
RANGE, LEAST_RANGES = 1 << 23, 16
#: The training count of most words outside of the dictionary: it is not sent, and stands where no count came.
ONCE = 1
DISCOUNT = 0.75
#: Tokens worked on at once.
CHUNK = 1 << 20
#: Logarithms are summed as whole multiples of 1 / UNIT.
UNIT = float(1 << 32)
END = np.array([xxhash.xxh3_64_intdigest(b"\n")], np.uint64)  # no word holds a line end
#: Hashes that stand for the text's begin, and for nothing before it.
_EDGES = np.array([xxhash.xxh3_64_intdigest(b"\n\n"), xxhash.xxh3_64_intdigest(b"\n\n\n")], np.uint64)
TRAIN, SCORE = 1, 2
#: Rows that go to a part: its positions in a chunk, answers (words, hot pairs), a chunk's texts (passed on).
DEALT, WORDS, PAIRS, TEXTS = 0, 1, 2, 3
#: Rows of answers only: how many words follow a hot one.
FOLLOW = 4
_BLOBS = ["docs", "runs", "rare", "middle", "w"]
_SENT = ", ".join(["part int", "kind int", "chunk long", *[f"{x} binary" for x in _BLOBS]])
_SUMS = ["docs", "score", "at", "known", "base"]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Rows of a batch in chunks: (row numbers, token hashes end to end, begin of each text)."""
    for b in batches:
        rows, parts, size = [], [], 0
        for i, text in enumerate(b.column("text").to_pylist()):
            words = words_of(text, lower=True)
            rows.append(i)
            parts.append(np.append(word_hashes(words, len(words)), END))
            size += len(words) + 1
            if size >= CHUNK:
                yield b, rows, np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts[:-1]])
                rows, parts, size = [], [], 0
        if rows:
            yield b, rows, np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts[:-1]])


def _narrowed(rows: DataFrame, key, low: int, high: int, most: int) -> tuple[int, int]:
    """The least ``v`` in low..high so that at most ``most`` rows have a key
    above it, and how many have; counts of 65,536 ranges of values at a time."""
    above = 0
    while low < high:
        width = -(-(high - low + 1) // (1 << 16))
        by = dict(rows.where(key.between(low, high)).groupBy(F.floor((key - low) / width).cast("long").alias("b")).count().collect())
        for b in sorted(by, reverse=True):
            if above + by[b] > most:
                break
            above += by[b]
        else:
            return low - 1, above
        low, high = low + b * width, min(high, low + b * width + width - 1)
    return low, above


def most_frequent(counts: DataFrame, n: str, most: int, *more: str) -> tuple[np.ndarray, ...]:
    """Hashes and counts (and ``more`` columns) of the most frequent rows, ``most`` at most, by
    descending count: the cut is found exactly from numbers of rows by ranges
    of counts, and ties at the cut by ranges of hashes, so that nothing is sorted."""
    top = counts.agg(F.max(n)).first()[0]
    if top is None or most <= 0:
        return tuple(np.zeros(0, np.int64) for _ in ("h", n, *more))
    cut, above = _narrowed(counts, F.col(n), 1, top, most)
    keep = F.col(n) > cut
    if cut >= 1:
        tie = F.shiftrightunsigned("h", 16)
        after, _ = _narrowed(counts.where(F.col(n) == cut), tie, 0, (1 << 48) - 1, most - above)
        keep = keep | ((F.col(n) == cut) & (tie > after))
    got = [x.to_numpy() for x in counts.where(keep).select("h", n, *more).toArrow().columns]
    order = np.lexsort((got[0], -got[1]))
    return tuple(x[order] for x in got)


def word_counts(rows: DataFrame) -> DataFrame:
    """(h, c, m): how often each word, or the end, is met in training, and in all rows."""

    def count(batches):
        for b, at, h, begin in _texts(batches):
            train = np.repeat(b.column("use").to_numpy()[at] & TRAIN, np.diff(np.append(begin, len(h))))
            k, back, m = np.unique(h, return_inverse=True, return_counts=True)
            c = np.bincount(back, train, len(k)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c), pa.array(m.astype(np.int64))], ["h", "c", "m"])

    return rows.select("text", "use").mapInArrow(count, "h long, c long, m long").groupBy("h").agg(F.sum("c").alias("c"), F.sum("m").alias("m"))


class Dictionary:
    """The most frequent words, numbered by descending count, then the two
    edges; numbers from ``size`` on are for words outside of it. ``subs``: over
    how many parts a middle word is dealt; ``ranges``: of hashes, for requests."""

    def __init__(self, h: np.ndarray, m: np.ndarray, c: np.ndarray, parts: int, hot: int, total: int, kinds: int, ranges: int):
        """Hashes, counts in all rows and counts in training; all words and distinct words of training."""
        self.total, self.kinds, self.ranges = total, kinds, ranges
        self.parts, self.begin, self.none, self.size = parts, len(h), len(h) + 1, len(h) + 2
        self.hash, self.c = np.append(h, _EDGES), np.append(c, [c[h == END].sum(), 0]).astype(np.int64)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        m = np.append(m, [m[h == END].sum(), 0]).astype(np.int64)
        self.subs = np.where(m > hot, -(-m // hot), 1)
        self.subs[:-2][h == END] = 1  # nothing follows it
        self.base = np.append(self.add_one(self.c), 0)  # the last one: for words outside

    def add_one(self, c: np.ndarray) -> np.ndarray:
        """The add-one model's logarithm of words by their counts."""
        return np.rint((np.log10(c + 1) - np.log10(self.total + self.kinds + 1)) * UNIT).astype(np.int64)

    def ranged(self, h: np.ndarray) -> np.ndarray:
        """The order of hashes in which requests are answered: by range, then by hash."""
        return np.lexsort((h, h & np.uint64(self.ranges - 1)))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words (-1: not here)."""
        if not len(self.sorted):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)

    def positions(self, h: np.ndarray, begin: np.ndarray):
        """Of texts laid end to end: each position's numbers, oldest first, its
        part, whether its middle word is dealt over several, and the hashes of all numbers."""
        word, back = np.unique(h, return_inverse=True)
        number = self.find(word)
        rare = number < 0
        number[rare] = self.size + np.arange(rare.sum())
        hashes = np.concatenate([self.hash, word[rare]])
        w3 = number[back]
        w2 = np.append(self.begin, w3[:-1])
        w2[begin] = self.begin
        w1 = np.append(self.none, w2[:-1])
        w1[begin] = self.none
        subs = np.where(w2 < self.size, self.subs[np.minimum(w2, self.size - 1)], 1)
        hot = subs > 1
        key = hashes[w2]
        by = np.where(w2 == self.begin, w3, w1)[hot]
        key[hot] += (mix(hashes[by]) % subs[hot].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return w1, w2, w3, (mix(key) % np.uint64(self.parts)).astype(np.int64), hot, hashes


def _pair(h2: np.ndarray, h3: np.ndarray) -> np.ndarray:
    return mix(h2 * np.uint64(0x9E3779B97F4A7C15) + h3).view(np.int64)


def _packed(x: np.ndarray, repeats: bool = True) -> bytes:
    """Numbers of 0 or more byte by byte, the lowest bytes of all first, as many bytes each as the
    largest needs, deflated without header; no ``repeats``: without looking for strings that repeat."""
    planes = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    z = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS, 8, zlib.Z_DEFAULT_STRATEGY if repeats else zlib.Z_HUFFMAN_ONLY)
    return bytes([planes]) + z.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :planes].T)) + z.flush()


def _unpacked(raw: bytes, dtype: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(raw[1:], -zlib.MAX_WBITS), np.uint8).reshape(raw[0], -1)
    return sum(p.astype(dtype) << dtype(8 * i) for i, p in enumerate(planes))


def _deflated(x: np.ndarray) -> bytes:
    """Numbers under 1 << 32 byte by byte, their lowest bytes first, deflated: small ones take next to nothing."""
    return zlib.compress(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T), 1)


def _inflated(raw: bytes) -> np.ndarray:
    return sum(p.astype(np.int64) << (8 * i) for i, p in enumerate(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1)))


def _keys(k: np.ndarray) -> bytes:
    """Ascending keys: the first one, and the steps from each to the next."""
    return k[:1].tobytes() + _deflated(np.diff(k, prepend=k[0]))


def _read_keys(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[:8], np.int64) + np.cumsum(_inflated(raw[8:]))


def dealt(rows: DataFrame, shared) -> DataFrame:
    """The positions of all texts by part, one row a part and chunk; and each chunk's texts with what needs no part."""

    def deal(batches):
        for b, at, h, begin in _texts(batches):
            d = shared.value
            own = b.take(pa.array(at))
            chunk, use = own.column("k")[0].as_py(), own.column("use").to_numpy().astype(np.uint8)
            ids, named = own.column("doc_id").fill_null(0).to_numpy(), own.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            w1, w2, w3, part, _, hashes = d.positions(h, begin)
            size = np.diff(np.append(begin, len(h)))
            doc = np.repeat(np.arange(len(begin)), size)
            order = np.argsort(part.astype(np.uint16) if d.parts < 1 << 16 else part, kind="stable")
            one, starts = np.unique(part[order], return_index=True)
            cols: list[list] = [[] for _ in _BLOBS]
            for p in np.split(order, starts[1:]):
                at_doc = doc[p]
                first = np.flatnonzero(np.append(True, at_doc[1:] != at_doc[:-1]))
                docs, runs = at_doc[first], np.diff(np.append(first, len(p)))
                w = np.concatenate([w1[p], w2[p], w3[p]])
                out = w >= d.size
                rare, where = np.unique(w[out], return_inverse=True)
                w[out] = d.size + where
                middle, w2_at = np.unique(w[len(p):2 * len(p)], return_inverse=True)  # a part's middle words are few
                w[len(p):2 * len(p)] = w2_at
                for col, x in zip(cols, (_packed(np.diff(docs, prepend=0) << 2 | use[docs]), _packed(runs), hashes[rare].tobytes(), _packed(middle),
                                         b"".join(len(r).to_bytes(4, "little") + r for r in (_packed(i, j == 1) for j, i in enumerate(w.reshape(3, -1))))), strict=True):
                    col.append(x)
            in_dictionary = np.minimum(w3, d.size)
            texts = np.concatenate([ids, size, np.add.reduceat(np.append(d.c > 0, False)[in_dictionary].astype(np.int64), begin),
                                    np.add.reduceat(d.base[in_dictionary], begin), named, use]).astype(np.int64)
            n = len(one)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.append(one, chunk % d.parts).astype(np.int32)), pa.array(np.append(np.full(n, DEALT), TEXTS).astype(np.int32)),
                pa.array(np.full(n + 1, chunk)), *[pa.array([*c, zlib.compress(texts, 1) if f == "docs" else None], pa.binary())
                                                   for f, c in zip(_BLOBS, cols, strict=True)]], [f.split()[0] for f in _SENT.split(", ")])

    return rows.mapInArrow(deal, _SENT)


def asked(rows: DataFrame, shared) -> DataFrame:
    """By hash range, one row a chunk and kind: which words outside the
    dictionary and pairs of frequent middle words (w: the middle word's number)
    a part needs, and training counts of the pairs (n)."""

    def ask(batches):
        for b, at, h, begin in _texts(batches):
            d = shared.value
            train = np.repeat(b.take(pa.array(at)).column("use").to_numpy() & TRAIN, np.diff(np.append(begin, len(h))))
            _, w2, w3, part, hot, hashes = d.positions(h, begin)
            for kind, own in ((WORDS, w3 >= d.size), (PAIRS, hot)):
                own = np.flatnonzero(own)
                if not len(own):
                    continue
                x = hashes[w3[own]] if kind == WORDS else _pair(hashes[w2[own]], hashes[w3[own]]).view(np.uint64)
                p, m, t = part[own], w2[own], train[own].astype(np.int64)
                r = (x & np.uint64(d.ranges - 1)).astype(np.int64)
                order = np.lexsort((p, x, r))
                r, p, x, m, t = r[order], p[order], x[order], m[order], t[order]
                new = np.flatnonzero(np.append(True, (p[1:] != p[:-1]) | (x[1:] != x[:-1])))
                r, p, x, m, t = r[new], p[new], x[new], m[new], np.add.reduceat(t, new)
                cut = np.flatnonzero(np.diff(r)) + 1
                cols = [[_packed(np.diff(i, prepend=np.uint64(0)), False) for i in np.split(x, cut)], [_packed(i) for i in np.split(p, cut)],
                        *[[_packed(i) if kind == PAIRS else None for i in np.split(j, cut)] for j in (m, t)]]
                yield pa.RecordBatch.from_arrays([pa.array(r[np.append(0, cut)].astype(np.int32)), pa.array(np.full(len(cut) + 1, kind, np.int32)),
                                                  *[pa.array(c, pa.binary()) for c in cols]], ["r", "kind", "x", "p", "m", "t"])

    return rows.mapInArrow(ask, "r int, kind int, x binary, p binary, m binary, t binary")


def _looked_up(keys: np.ndarray, values: np.ndarray, want: np.ndarray, other: int = 0) -> np.ndarray:
    """The value of each wanted key, ``other`` if it is not there."""
    if not len(keys):
        return np.full(len(want), other, np.int64)
    order = np.argsort(keys)
    at = order[np.minimum(np.searchsorted(keys, want, sorter=order), len(keys) - 1)]
    return np.where(keys[at] == want, values[at], other)


def answered(requests: DataFrame, words: DataFrame, ranges: int) -> DataFrame:
    """Counts by part, kind and hash range (``chunk``), bare, in the order of the
    hashes asked for: in ``w``, training counts of words or hot pairs. Rows of
    kind FOLLOW say how many pairs (n) of a range begin with a hot word (m)."""

    def answer(batches):
        for r, own in _groups(batches, "r"):
            known = own.filter(pa.compute.is_valid(own.column("h")))
            for kind in (WORDS, PAIRS):
                asks = own.filter(pa.compute.equal(own.column("kind"), kind)).select(["x", "p", "m", "t"]).to_pylist()
                if not asks:
                    continue
                x = np.concatenate([np.cumsum(_unpacked(a["x"], np.uint64), dtype=np.uint64) for a in asks])
                p = np.concatenate([_unpacked(a["p"]) for a in asks])
                one, back = np.unique(x, return_inverse=True)
                if kind == WORDS:
                    n = _looked_up(known.column("h").to_numpy(), known.column("n").to_numpy(), one.view(np.int64), ONCE)
                else:
                    n = np.zeros(len(one), np.int64)
                    np.add.at(n, back, np.concatenate([_unpacked(a["t"]) for a in asks]))
                    middle = np.zeros(len(one), np.int64)
                    middle[back] = np.concatenate([_unpacked(a["m"]) for a in asks])
                    w, times = np.unique(middle[n > 0], return_counts=True)
                    yield _batch(_ANSWERS, len(w), part=0, kind=FOLLOW, chunk=r, m=w, n=times)
                want = np.unique(p * len(one) + back)  # by part, then by hash
                parts, starts = np.unique(want // len(one), return_index=True)
                got = [_packed(n[i]) for i in np.split(want % len(one), starts[1:])]
                yield _batch(_ANSWERS, len(parts), part=parts, kind=kind, chunk=r, w=got)

    told = words.where(F.col("c") != ONCE).select(F.col("h").bitwiseAND(ranges - 1).cast("int").alias("r"), "h", F.col("c").alias("n"))
    return requests.unionByName(told, allowMissingColumns=True).repartition(ranges, "r").sortWithinPartitions("r").mapInArrow(answer, _ANSWERS)


def _part_scores(d: Dictionary, blobs: list[dict], words: np.ndarray, pairs: np.ndarray, after: np.ndarray, off: float):
    """Of a part's positions, by chunk: the texts' sums of the model, and of those
    words outside the dictionary how many are known and the add-one model's sum.
    ``words``, ``pairs``: the answers, in ``ranged`` order."""
    total, kinds = d.total, d.kinds
    runs = [_unpacked(x["runs"]) for x in blobs]
    rare, where = np.unique(np.concatenate([np.frombuffer(x["rare"], np.uint64) for x in blobs]), return_inverse=True)
    columns, used = [], 0
    for x in blobs:
        w, raw = [], x["w"]
        while raw:
            size = 4 + int.from_bytes(raw[:4], "little")
            w.append(_unpacked(raw[4:size], np.int32))
            raw = raw[size:]
        w[1] = _unpacked(x["middle"], np.int32)[w[1]]
        w = np.stack(w)
        own = len(x["rare"]) // 8
        out = w >= d.size
        w[out] = d.size + where[used:used + own][w[out] - d.size]
        used += own
        columns.append(w)
    w1, w2, w3 = np.concatenate(columns, 1)
    columns.clear()
    docs = [_unpacked(x["docs"]) for x in blobs]  # steps from text to text, and their use
    runs, ends = np.concatenate(runs), np.cumsum([len(x) for x in docs])
    use, docs = np.concatenate(docs) & 3, np.concatenate([np.cumsum(x >> 2) for x in docs])
    train, ask = np.repeat(use & TRAIN > 0, runs), np.repeat(use & SCORE > 0, runs)
    hashes = np.concatenate([d.hash, rare])

    def asked_for(x, counts):
        """Counts of hashes, from the answers."""
        one, back = np.unique(x, return_inverse=True)
        if len(one) != len(counts):
            raise ValueError(f"{len(counts)} answers to {len(one)} requests")
        n = np.zeros(len(one), np.int64)
        n[d.ranged(one)] = counts
        return one, n

    last = np.unique(w3[w3 >= d.size])
    words = asked_for(hashes[last], words)
    is_hot = np.append(d.subs > 1, False)
    hot = np.flatnonzero(is_hot[np.minimum(w2, d.size)])
    pairs = asked_for(_pair(hashes[w2[hot]], hashes[w3[hot]]).view(np.uint64), pairs)
    trie = PartTrie(w1[train], w2[train], w3[train], d.none)
    doc = np.repeat(np.arange(len(runs)), runs)[ask]
    if not len(doc):
        return
    v = d.size + len(rare)
    pair, of = np.unique(w2[ask].astype(np.int64) * v + w3[ask], return_inverse=True)
    triple, back = np.unique(of * v + w1[ask], return_inverse=True)  # each one is looked up once
    del of, train, ask
    at, w1 = triple // v, triple % v
    w2, w3 = pair // v, pair % v
    c = np.where(w3 < d.size, d.c[np.minimum(w3, d.size - 1)], 0)
    out = w3 >= d.size
    c[out] = words[1][np.searchsorted(words[0], hashes[w3[out]])]
    c1, t2, c2, place, rank = trie.pairs(w2, w3)
    hot = np.flatnonzero(is_hot[np.minimum(w2, d.size)])
    c1[hot], t2[hot] = d.c[w2[hot]], after[w2[hot]]
    c2[hot] = pairs[1][np.searchsorted(pairs[0], _pair(hashes[w2[hot]], hashes[w3[hot]]).view(np.uint64))]
    c12, t12, c3 = trie.triples(w1, place[at], rank[at])

    def smoothed(n, all_, types, shorter):
        return np.where(all_ > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * types * shorter) / np.maximum(all_, 1), shorter)

    p1 = np.where(c > 0, (c - off) / max(1, total), off * kinds / total if total else 1.0)
    p = smoothed(c3, c12, t12, smoothed(c2, c1, t2, p1)[at])
    score = np.rint(-np.log10(np.maximum(p, 1e-300)) * UNIT).astype(np.int64)[back]  # 0 or more
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    rows, score = doc[starts], np.add.reduceat(score, starts)
    outside = np.flatnonzero(out[at][back])
    one = at[back[outside]]
    to, first = np.unique(doc[outside], return_index=True)
    known, base = (np.add.reduceat(x, first) if len(first) else x for x in ((c[one] > 0).astype(np.int64), -d.add_one(c[one])))
    to = np.searchsorted(rows, to)
    for x, s, e in zip(blobs, np.searchsorted(rows, ends - np.diff(ends, prepend=0)), np.searchsorted(rows, ends), strict=True):
        if s < e:
            i = slice(*np.searchsorted(to, [s, e]))
            sparse = (_keys(to[i] - s), _packed(known[i]), _packed(base[i])) if i.start < i.stop else (None,) * 3
            yield x["chunk"], _packed(np.diff(docs[rows[s:e]], prepend=0)), _packed(score[s:e], False), *sparse


_ANSWERS = "part int, kind int, chunk long, w binary, m long, n long"


def _batch(schema: str, rows: int, **columns) -> pa.RecordBatch:
    """Rows of a schema: a column is an array, a list, one value for all, or absent (null)."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([
        pa.nulls(rows, types[t]) if f not in columns else pa.array(columns[f] if np.ndim(columns[f]) or isinstance(columns[f], list) else [columns[f]] * rows, types[t])
        for f, t in fields], [f for f, _ in fields])


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """Rows by their key, in which they are sorted."""
    at, held = None, []
    for b in batches:
        k = b.column(key).to_numpy()
        cuts = np.flatnonzero(np.diff(k)) + 1
        for s, e in zip(np.append(0, cuts), np.append(cuts, len(k)), strict=True):
            if s < e:
                if held and k[s] != at:
                    yield at, pa.Table.from_batches(held)
                    held = []
                at = int(k[s])
                held.append(b.slice(s, e - s))
    if held:
        yield at, pa.Table.from_batches(held)


def _gathered(sums: DataFrame, total: int) -> DataFrame:
    """A row a scored text, from its chunk's sums by part (a row without ``score`` is the chunk's texts)."""
    columns = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def gather(batches):
        for _, own in _groups(batches, "chunk"):
            rows = own.to_pylist()
            texts = next(x["docs"] for x in rows if x["score"] is None)
            texts = np.frombuffer(zlib.decompress(texts), np.int64).reshape(6, -1).copy()
            ids, size, known, base, named, use = texts
            score = np.zeros(len(ids), np.int64)
            for x in rows:
                if x["score"] is not None:
                    docs = np.cumsum(_unpacked(x["docs"]))  # each one once
                    score[docs] -= _unpacked(x["score"])
                    if x["at"] is not None:
                        docs = docs[_read_keys(x["at"])]
                        known[docs] += _unpacked(x["known"])
                        base[docs] -= _unpacked(x["base"])
            own = np.flatnonzero(use & SCORE)
            yield pa.RecordBatch.from_arrays([
                pa.array(ids[own], mask=named[own] == 0), pa.array(size[own]), pa.array(known[own]), pa.array(np.full(len(own), total, np.int64)),
                pa.array(base[own] / UNIT), pa.array(score[own] / UNIT)], [f.split()[0] for f in columns.split(", ")])

    return sums.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(gather, columns)


def _scored(rows: DataFrame) -> DataFrame:
    """``rows``: doc_id, text and use (TRAIN, SCORE or both)."""
    spark = rows.sparkSession
    words = written(spark, word_counts(rows), "lm-words")
    met, every, total, kinds, once, twice = (x or 0 for x in words.agg(F.sum("m"), F.count("*"), F.sum("c"), *[
        F.sum(x.cast("long")) for x in (F.col("c") > 0, F.col("c") == 1, F.col("c") == 2)]).first())
    off = once / (once + 2 * twice) if once and twice else 0.5  # discount of a word's count
    h, m, c = most_frequent(words, "m", DICTIONARY, "c")
    ranges = max(LEAST_RANGES, 1 << (-(-met // RANGE) - 1).bit_length())
    dictionary = Dictionary(h.view(np.uint64), m, c, max(LEAST_PARTS, -(-met // PART)), HOT, total, kinds, ranges)
    shared = spark.sparkContext.broadcast(dictionary)
    keyed = rows.select("doc_id", F.monotonically_increasing_id().alias("k"), "text", F.col("use").cast("int").alias("use"))
    positions = dealt(keyed, shared)
    after = np.zeros(dictionary.size, np.int64)  # frequent middle words: how many words follow each
    if (dictionary.subs > 1).any() or every > len(h):
        answers = written(spark, answered(asked(keyed.drop("doc_id", "k"), shared), words, ranges), "lm-answers")
        for w, n in answers.where(F.col("kind") == FOLLOW).groupBy("m").agg(F.sum("n")).collect():
            after[w] = n
        positions = positions.unionByName(answers.where(F.col("kind") != FOLLOW).select("part", "kind", "chunk", "w"), allowMissingColumns=True)
    follow = spark.sparkContext.broadcast(after)

    def score(batches):
        for _, own in _groups(batches, "part"):
            by = {k: own.filter(pa.compute.equal(own.column("kind"), k)) for k in (DEALT, WORDS, PAIRS, TEXTS)}
            del own
            for chunk, docs in zip(by[TEXTS].column("chunk").to_pylist(), by[TEXTS].column("docs").to_pylist(), strict=True):
                yield _batch(sums, 1, chunk=chunk, docs=[docs])
            known = [np.concatenate([np.zeros(0, np.int64), *[_unpacked(x) for _, x in sorted(zip(
                by[k].column("chunk").to_pylist(), by[k].column("w").to_pylist(), strict=True))]]) for k in (WORDS, PAIRS)]
            blobs = by.pop(DEALT).select(["chunk", *_BLOBS]).to_pylist()
            by.clear()
            if blobs:
                out = list(_part_scores(shared.value, blobs, *known, follow.value, off))
                if out:
                    yield _batch(sums, len(out), **dict(zip(["chunk", *_SUMS], map(list, zip(*out, strict=True)), strict=True)))

    sums = ", ".join(["chunk long", *[f"{x} binary" for x in _SUMS]])
    return _gathered(positions.repartition(dictionary.parts, "part").sortWithinPartitions("part").mapInArrow(score, sums), int(total))


def scored(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``."""
    return _scored(docs.select("doc_id", "text", F.lit(SCORE).alias("use")).unionByName(
        training.select("doc_id", "text", F.lit(TRAIN).alias("use"))))


def is_held_out(doc_id):
    return held_out(doc_id, FOLDS, HELD_OUT_FOLD)


def query(spark, sf_dir) -> DataFrame:
    docs = keep_columns(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string"})
    use = F.when(is_held_out(F.col("doc_id")), F.lit(SCORE)).otherwise(F.lit(SCORE + TRAIN))  # one pass for both
    return _scored(docs.withColumn("use", use)).withColumn("held_out", is_held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
