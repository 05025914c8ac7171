"""Cross-tokenizer alignment: byte-exact groups and links between the tokens
of two tokenizers over the same text.

Every text is encoded by a byte-level vocabulary (A, over a space and the
text) and a piece vocabulary (B, which adds that space itself). All tokens of
a block of texts are lexsorted by start and coalesced as intervals:
``maximum.accumulate`` carries the furthest end so far, and a group breaks
where a start reaches it. Within a group every A token is linked with each B
token whose byte range it overlaps.

How often an (A id, B id) pair is linked, in how many documents of the whole
corpus, is a DataFrame aggregation over the written pairs of each document.
The counts go back to the documents by a broadcast join while their table fits
the checked limit, and by a salted shuffled join beyond it.

Defined results: a null or empty text, or one whose joined token bytes differ
from a space and the text (for A or B), has no tokens, so no groups and no
links; repeated rows are documents of their own, each counted; a null id stays
null; other columns of the input don't matter; an empty table gives no rows.
Texts are taken whole, a block holds at least one however long it is."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespanel.llm.common import BROADCAST_BYTES, keep_columns, table, written

TOKENIZERS = "/opt/tokenizers"
FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text bytes that are encoded and aligned at a time.
STEP_BYTES = 1 << 20
#: Units (mostly words) whose ids a Python worker remembers, and those it encodes in one call.
KNOWN_UNITS, UNITS_AT_ONCE = 400_000, 4096
#: Reckoned bytes of a pair in a broadcast (key, count, flag, and the hash table's own).
PAIR_BYTES = 64
#: Copies of the pair table that the documents' pairs are dealt over if it can't be broadcast.
SALTS = 16

SEPARATORS = (",", "|", ";", "")


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the
    others for the characters from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of every id, and ids as text with each separator."""

    def __init__(self, file_a: bytes, file_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(file_a.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=file_b)
        alphabet = byte_of_char()
        entries = self.a.get_vocab(with_added_tokens=True)
        bytes_a = [b""] * (max(entries.values(), default=-1) + 1)
        for entry, i in entries.items():
            plain = all(c in alphabet for c in entry)
            bytes_a[i] = bytes(alphabet[c] for c in entry) if plain else entry.encode("utf-8")
        bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            single = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            bytes_b.append(bytes([int(single[1], 16)]) if single else piece.replace("▁", " ").encode("utf-8"))
        self.bytes_of = (bytes_a, bytes_b)
        self.lengths = tuple(np.array([len(x) for x in t], np.int64) for t in self.bytes_of)
        # ids of both sides as text with each separator, B's behind A's
        self.shown = [f"{i}{s}" for t in self.bytes_of for i in range(len(t)) for s in SEPARATORS]
        # A cuts before a space and an ASCII letter, digit or mark, whatever lies around; so does B if none of its
        # pieces has a space behind another character. Else texts are encoded as they are.
        self.cuts = type(self.a.pre_tokenizer).__name__ == "ByteLevel" and self.a.normalizer is None and not any(
            re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(self.b.get_piece_size()))
        self.units = re.compile(r" (?=[!-~])(?<=[^ ▁] )" if self.cuts else r"(?!)").split
        self.forget()

    def forget(self) -> None:
        """Empties the memory of units: their numbers, their ids laid end to
        end on each side, which are odd (their bytes, for A or B, are not a
        space and the unit), and their alignment: groups, linked pairs laid end to end, groups as text."""
        self.number: dict[str, int] = {}
        self.ids = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.sizes = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.odd = np.zeros(0, bool)
        self.groups, self.n_links, self.links = (np.zeros(0, np.int64) for _ in range(3))
        self.texts: list[str] = []

    def _same(self, want: bytes, *sides: list[int]) -> bool:
        return all(b"".join(map(of.__getitem__, ids)) == want for of, ids in zip(self.bytes_of, sides))

    def _apart(self, units: list[str]):
        """(ids, sizes of each unit) of both sides, and which units are odd."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        odd = [not self._same((" " + u).encode("utf-8", "surrogatepass"), x, y) for u, x, y in zip(units, a, b)]
        return [(np.array(list(chain.from_iterable(s)), np.int64), np.array([len(x) for x in s])) for s in (a, b)], odd

    def _joined(self, units: list[str]):
        """The same for units that are cut from each other wherever they meet: encoded as one text whose tokens are cut at their ends."""
        text = " ".join(units)
        sides = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text)
        if not self._same((" " + text).encode("utf-8", "surrogatepass"), *sides):
            return self._apart(units)  # one of them is odd
        ends = np.cumsum([1 + len(u.encode("utf-8")) for u in units])
        found = []
        for ids, lengths in zip((np.array(s) for s in sides), self.lengths):
            found.append((ids, np.diff(np.searchsorted(np.cumsum(lengths[ids]), ends) + 1, prepend=0)))
        return found, [False] * len(units)

    def _learn(self, units: set[str]) -> None:
        apart = [u for u in units if not (self.cuts and "!" <= u[:1] <= "~" and u[-1] not in " ▁")]
        found = []
        for how, some in ((self._apart, apart), (self._joined, list(units.difference(apart)))):
            for k in range(0, len(some), UNITS_AT_ONCE):
                few = some[k:k + UNITS_AT_ONCE]
                self.number.update(zip(few, range(len(self.number), len(self.number) + len(few))))
                found.append(how(few))
        odd = np.concatenate([np.zeros(0, bool), *[np.array(o, bool) for _, o in found]])
        sides = []
        for s in (0, 1):
            ids = np.concatenate([np.zeros(0, np.int64), *[f[s][0] for f, _ in found]])
            sizes = np.concatenate([np.zeros(0, np.int64), *[f[s][1] for f, _ in found]])
            sides.append((ids[np.repeat(~odd, sizes)], np.repeat(np.arange(len(sizes)), np.where(odd, 0, sizes))))
            self.ids[s], self.sizes[s] = np.concatenate([self.ids[s], ids]), np.concatenate([self.sizes[s], sizes])
        self.odd = np.concatenate([self.odd, odd])
        m = aligned_ids(len(odd), sides, self)
        i, j = m.links
        self.groups = np.concatenate([self.groups, m.n_groups()])
        self.n_links = np.concatenate([self.n_links, m.per_doc(m.docs[0][i])])
        self.links = np.concatenate([self.links, m.ids[0][i] * len(self.bytes_of[1]) + m.ids[1][j]])
        self.texts += m.group_texts(self)

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all units of the texts in order, learning new ones,
        and the text of each; a text has none where its bytes on a side are not a space and the text."""
        units = [self.units(t) if t else [] for t in texts]
        if len(self.number) > KNOWN_UNITS:
            self.forget()
        self._learn(set().union(*units).difference(self.number))
        unit = np.fromiter(map(self.number.__getitem__, chain.from_iterable(units)), np.int64)
        doc = np.repeat(np.arange(len(texts)), [len(us) for us in units])
        whole = ~np.isin(doc, doc[self.odd[unit]])
        return unit[whole], doc[whole]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For A and B, all ids of the texts in order, and the text of each."""
        unit, doc = self.cut(texts)
        return [(_runs(ids, sizes, unit), np.repeat(doc, sizes[unit])) for ids, sizes in zip(self.ids, self.sizes)]


def _runs(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The chosen runs of values laid end to end, one after the other."""
    n = sizes[which]
    first = (np.cumsum(sizes) - sizes)[which]
    return values[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]


@functools.lru_cache(maxsize=2)
def pair_of(file_a: bytes, file_b: bytes) -> Pair:
    """The pair of these files' contents, built once in a Python worker."""
    return Pair(file_a, file_b)


def tokenizer_files(folder: str = TOKENIZERS) -> tuple[bytes, bytes]:
    """Contents of both files; they go to the tasks with the code, so that executors need no copy of the folder."""
    def content(name: str) -> bytes:
        with open(os.path.join(folder, name), "rb") as f:
            return f.read()

    a = content(FILE_A)
    json.loads(a)  # a clear error in the driver rather than in every task
    return a, content(FILE_B)


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The group of every interval: intervals are taken by start, and a new
    group begins where a start reaches the furthest end before it."""
    if not len(starts):
        return np.zeros(0, np.int64)
    order = np.lexsort((side, starts))
    s, furthest = starts[order], np.maximum.accumulate(ends[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.concatenate(([0], s[1:] >= furthest[:-1])))
    return group


def overlaps(start_a, end_a, start_b, end_b) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all pairs of A and B intervals that share a byte; each side in order, without gaps or overlaps of its own."""
    low, high = np.searchsorted(end_b, start_a, "right"), np.searchsorted(start_b, end_a, "left")
    n = high - low
    i = np.repeat(np.arange(len(start_a)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


@dataclass
class Alignment:
    """A block of texts laid end to end. ``docs_*`` give each token's text,
    ``group_*`` its group (numbered over the block), ``links`` the token index pairs."""

    n: int
    ids: tuple[np.ndarray, np.ndarray]
    docs: tuple[np.ndarray, np.ndarray]
    group: tuple[np.ndarray, np.ndarray]
    links: tuple[np.ndarray, np.ndarray]

    def per_doc(self, docs: np.ndarray) -> np.ndarray:
        return np.bincount(docs, minlength=self.n)

    def n_groups(self) -> np.ndarray:
        """Groups of each text; a group has A tokens, and all of one text."""
        return self.per_doc(self.docs[0][np.unique(self.group[0], return_index=True)[1]])

    def group_texts(self, pair: Pair) -> list[str]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
        side, group = np.repeat((0, 1), [len(x) for x in self.ids]), np.concatenate(self.group)
        order = np.lexsort((side, group))
        side, group, doc = side[order], group[order], np.concatenate(self.docs)[order]
        separator = np.full(len(order), 3)
        separator[:-1] = np.where(doc[1:] != doc[:-1], 3, np.where(group[1:] != group[:-1], 2, side[1:] != side[:-1]))
        ids = np.concatenate((self.ids[0], self.ids[1] + len(pair.bytes_of[0])))[order]
        shown = list(map(pair.shown.__getitem__, (ids * len(SEPARATORS) + separator).tolist()))
        ends = np.cumsum(self.per_doc(doc)).tolist()
        return ["".join(shown[a:b]) for a, b in zip([0, *ends[:-1]], ends)]


def aligned_ids(n: int, sides: list[tuple[np.ndarray, np.ndarray]], pair: Pair) -> Alignment:
    """Aligns n texts given by all ids of each side and the text of each id."""
    starts, ends = [], []
    for lengths, (ids, _) in zip(pair.lengths, sides):
        ends.append(np.cumsum(lengths[ids]))
        starts.append(ends[-1] - lengths[ids])
    na = len(starts[0])
    group = coalesce(np.concatenate(starts), np.concatenate(ends), np.repeat((0, 1), [na, len(starts[1])]))
    return Alignment(n, tuple(ids for ids, _ in sides), tuple(doc for _, doc in sides), (group[:na], group[na:]),
                     overlaps(starts[0], ends[0], starts[1], ends[1]))


def align(texts: list[str], pair: Pair) -> Alignment:
    """Encodes and aligns a block of texts."""
    return aligned_ids(len(texts), pair.encode(texts), pair)


@dataclass
class Summary:
    """Of a block of texts: each one's tokens of both sides, groups, links and
    groups as text; and (text, A id, B id, times) of every pair linked in a text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    shown: list[str]
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def summary(texts: list[str], pair: Pair) -> Summary:
    """What ``align`` finds, put together from the alignments of the units: both
    sides end a token where units are cut, so no group and no link goes across."""
    unit, doc = pair.cut(texts)
    count = lambda of: np.bincount(doc, of[unit], len(texts)).astype(np.int64)
    ends = np.cumsum(np.bincount(doc, minlength=len(texts))).tolist()
    parts = list(map(pair.texts.__getitem__, unit.tolist()))
    na, nb = (len(t) for t in pair.bytes_of)
    key = np.repeat(doc, pair.n_links[unit]) * (na * nb) + _runs(pair.links, pair.n_links, unit)
    key, times = np.unique(key, return_counts=True)
    return Summary(count(pair.sizes[0]), count(pair.sizes[1]), count(pair.groups), count(pair.n_links),
                   [";".join(parts[a:b]) for a, b in zip([0, *ends[:-1]], ends)], (key // (na * nb), key // nb % na, key % nb, times))


def blocks(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about STEP_BYTES of text each, and their texts (null: empty)."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        first, held = 0, 0
        for k, t in enumerate(texts):
            held += len(t)
            if held >= STEP_BYTES or k + 1 == len(texts):
                yield batch.slice(first, k + 1 - first), texts[first:k + 1]
                first, held = k + 1, 0


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, kind))


def _own(docs: DataFrame) -> DataFrame:
    """The columns needed; a table that lies in fewer pieces than there are
    cores (one small file) is dealt over all of them, as encoding is the cost."""
    own = keep_columns(docs, {"doc_id": "long", "text": "string"})
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return own.repartition(cores) if own.rdd.getNumPartitions() < cores else own


def aligned(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_group, b_group) of every document: its tokens
    of both sides in order, and for each the number of its group, from 0."""
    files = tokenizer_files(folder)

    def run(batches):
        pair = pair_of(*files)
        for batch, texts in blocks(batches, "text"):
            m = align(texts, pair)
            first = np.zeros(m.n, np.int64)
            if len(m.docs[0]):
                held, at = np.unique(m.docs[0], return_index=True)
                first[held] = m.group[0][at]
            out = [batch.column("doc_id")]
            out += [_lists(m.ids[s], m.per_doc(m.docs[s]), pa.int32()) for s in (0, 1)]
            out += [_lists(m.group[s] - first[m.docs[s]], m.per_doc(m.docs[s]), pa.int32()) for s in (0, 1)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "a_ids", "b_ids", "a_group", "b_group"])

    return _own(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_group array<int>, b_group array<int>")


def summaries(docs: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """One row a document: a key of the row, doc_id, token, group and link
    counts, the hash of its groups, and its linked pairs (a, b) with how often
    each is linked (times)."""
    files = tokenizer_files(folder)

    def run(batches):
        pair = pair_of(*files)
        for batch, texts in blocks(batches, "text"):
            m = summary(texts, pair)
            doc, a, b, times = m.pairs
            held = np.bincount(doc, minlength=len(texts))
            digest = [hashlib.sha256(t.encode("ascii")).hexdigest() if t else "" for t in m.shown]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"),
                 *[pa.array(x, pa.int64()) for x in (m.n_a, m.n_b, m.n_groups, m.n_links)],
                 pa.array(digest, pa.string()), _lists(a, held, pa.int32()), _lists(b, held, pa.int32()),
                 _lists(times, held, pa.int32())],
                ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "times"])

    own = _own(docs).withColumn("row", F.monotonically_increasing_id())
    return own.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                               "a array<int>, b array<int>, times array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents a pair is linked, and whether no
    other pair of the same A id is in more. ``found`` are written summaries."""
    n = found.select(F.inline(F.arrays_zip("a", "b"))).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def with_counts(found: DataFrame, pairs: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(row, n_best, count_sum) of every document with links, from its pairs and the corpus-wide counts (both written)."""
    asked = found.select("row", F.inline(F.arrays_zip("a", "b", "times")))
    if pairs.count() * PAIR_BYTES <= limit:
        met = asked.join(F.broadcast(pairs), ["a", "b"])
    else:  # a frequent pair is in nearly every document, so its rows are dealt over copies of the pair
        salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["a", "b", "salt"])
    return met.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def alignment_counts(docs: DataFrame, folder: str = TOKENIZERS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    spark = docs.sparkSession
    found = written(spark, summaries(docs, folder), "token-align")
    pairs = written(spark, pair_counts(found), "token-pairs")
    none = F.lit(0).cast("long")
    return found.drop("a", "b", "times").join(with_counts(found, pairs, limit), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"),
        F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def query(spark, sf_dir) -> DataFrame:
    return alignment_counts(table(spark, sf_dir, "documents"))
