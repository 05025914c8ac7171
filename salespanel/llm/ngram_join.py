"""N-gram Jaccard join with an R-tree over count vectors.

A document is its set of five-word shingles; two link if 100 times their
common shingles are at least 75 times those of either. Shingles hash into
groups, and a document's group counts are a point; two documents can't share
more than the sum of the smaller counts. The join runs in these steps:

1. Texts with equal sets fall into one class, worked on once.
2. Two sets that link share one of their first shingles in any fixed order (a
   quarter of the set and one). Documents are dealt out by these, in an order
   that puts shingles common in a sample last, so that shared passages rarely
   bring documents together. A shingle held by up to PAIR_CLASSES classes
   gives their pairs of similar size, one held by more a star around a class.
   With each shingle goes how many of its set are left from it on in that
   order: of two sets, the first shingle they share must leave enough in both.
3. Pairs of step 2 whose counts can't overlap enough go; the rest and the
   stars make groups, such that every link lies within a group.
4. A group's points are packed into an R-tree; boxes, then points, that can't
   overlap enough are passed over, and the sets of the others are compared in
   full. Groups above a tile's size are cut into tiles (by set size, then by
   hash) and worked on in pairs of tiles: first each with itself and with the
   group's first one, then all that has not joined its group's largest part
   against the rest. So no task holds a group, and links within one part are
   not counted out.
5. Links make components.

Defined results: letters A-Z are compared in lower case; a text of fewer than
five words is one shingle; null, empty and wordless texts have no shingle and
stay alone; equal rows share a component; rows with the same id and different
texts are each reported; an empty table gives no rows; other columns pass
through untouched."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salespanel.llm.common import (
    broadcast_if_small,
    give_back,
    keep_columns,
    mix,
    shielded,
    shingle_set,
    table,
    words_of,
    written,
)
from salespanel.llm.components import components

#: A link: SHARE per cent of the union are common.
SHARE = 75
GROUPS, MAX_GROUPS = 64, 4096
#: Every so many documents are looked at for common shingles; at most so many of these are put last.
SAMPLE_OF, SAMPLE_COUNT, MAX_COMMON = 16, 3, 500_000
#: Shingles held by more classes give a star instead of all pairs.
PAIR_CLASSES = 256
TILE = 512
LEAF = 16


def needed(a, b):
    """The least number of common shingles that links sets of a and b shingles."""
    return -(-SHARE * (a + b) // (100 + SHARE))


def class_of(s: np.ndarray) -> int:
    """A 63-bit name of a shingle set; equal sets have equal names."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def groups_for(n: int) -> int:
    """Number of groups for a set of n shingles: a power of two, so that finer
    counts fold into coarser ones, with about four shingles a group (two
    unrelated sets overlap in so many that fewer groups would not tell them apart)."""
    return int(min(MAX_GROUPS, max(GROUPS, 1 << max(0, (n // 4 - 1).bit_length()))))


def counts_of(s: np.ndarray, groups: int) -> np.ndarray:
    """Shingles by the first bits of their hash, shared by neighbours when folded."""
    at = (s >> np.uint64(65 - groups.bit_length())).astype(np.int64)
    return np.bincount(at, minlength=groups).astype(np.uint16)


def _points(blobs: pd.Series, groups: int) -> np.ndarray:
    """Counts, as stored, folded into so many groups."""
    own = np.frombuffer(b"".join(blobs), np.uint16).reshape(len(blobs), -1)
    return own.reshape(len(blobs), groups, -1).sum(2, dtype=np.int64)


def first_shingles(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The part of a set that any linked set shares something of, in the fixed order."""
    n = len(s)
    take = n - (-(-SHARE * n // 100)) + 1
    order = mix(s)
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        order = (order >> np.uint64(1)) | ((common[at] == s).astype(np.uint64) << np.uint64(63))
    own = np.argpartition(order, take - 1)[:take] if take < n else np.arange(n)
    return s[own[np.argsort(order[own])]]


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    values = np.concatenate(rows).view(np.int64) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def common_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles met several times among a hash-chosen part of the documents.
    They only set the order of step 2, and any order gives the same links."""
    part = docs.where(F.pmod(F.xxhash64(F.lit("common"), F.col("doc_id"), F.col("text")), F.lit(SAMPLE_OF)) == 0)

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(words_of(t, lower=True)) for t in b.column(0).to_pylist()]
            s, n = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int64))], ["s", "n"])
        give_back()

    seen = part.select("text").mapInArrow(shingles, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    rows = seen.where(F.col("n") >= SAMPLE_COUNT).orderBy(F.desc("n"), "s").limit(MAX_COMMON).toArrow()
    return np.sort(rows.column("s").to_numpy().view(np.uint64))


def signatures(docs: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, text_hash, cls, n, counts, first of every document; cls is null without shingles."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, n, counts, first = [], [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(words_of(t, lower=True))
                cls.append(class_of(s) if len(s) else None)
                n.append(len(s))
                counts.append(counts_of(s, groups_for(len(s))).tobytes())
                first.append(first_shingles(s, shared.value) if len(s) else s)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(cls, pa.int64()), pa.array(n, pa.int64()), pa.array(counts, pa.binary()), _lists(first)],
                ["doc_id", "text_hash", "cls", "n", "counts", "first"])
        give_back()

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(
        sign, "doc_id long, text_hash long, cls long, n long, counts binary, first array<long>")


class _Run:
    """The classes met under one shingle, in order; a long run keeps its first only."""

    def __init__(self, key):
        self.key, self.cls, self.size, self.long = key, np.zeros(0, np.int64), np.zeros(0, np.int64), False

    def add(self, cls: np.ndarray, size: np.ndarray, out: list) -> None:
        if not self.long and len(self.cls) + len(cls) <= PAIR_CLASSES:
            self.cls, self.size = np.append(self.cls, cls), np.append(self.size, size)
            return
        every = cls if self.long else np.append(self.cls, cls)
        self.long, self.cls = True, every[:1] if not self.long else self.cls
        out.append((np.full(len(every), self.cls[0]), every, np.ones(len(every), bool)))

    def close(self, out: list) -> None:
        if not self.long and len(self.cls) > 1:
            i, j = np.triu_indices(len(self.cls), 1)
            n, left = self.size >> 32, self.size & 0xFFFFFFFF
            # the least that links also rules out sets of too different a size, as ``left`` is at most n
            near = np.minimum(left[i], left[j]) >= needed(n[i], n[j])
            out.append((self.cls[i[near]], self.cls[j[near]], np.zeros(int(near.sum()), bool)))


def _meetings(sorted_rows: DataFrame) -> DataFrame:
    """(a, b, star) from rows (shingle, cls, size) that lie together by
    shingle and in order: all pairs of up to PAIR_CLASSES classes that could
    link with this as the first shingle they share, or edges of all to the
    first. ``size`` holds the set's size (upper half) and how many of it are
    left from this shingle on. Long runs are read through and never held."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, last_cls = None, None
        for b in batches:
            key, cls, size = (b.column(i).to_numpy() for i in range(3))
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            new[0] = run is None or key[0] != run.key or cls[0] != last_cls
            last_key, last_cls = key[-1], cls[-1]
            key, cls, size = key[new], cls[new], size[new]
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            ends = np.append(starts[1:], len(key))
            shown = ends - starts > 1
            shown[0] = shown[-1] = True  # these may go on from, or into, another batch
            out: list = []
            for i in np.flatnonzero(shown):
                if run is None or key[starts[i]] != run.key:
                    if run is not None:
                        run.close(out)
                    run = _Run(key[starts[i]])
                run.add(cls[starts[i]:ends[i]], size[starts[i]:ends[i]], out)
            yield _pairs(out)
        out = []
        if run is not None:
            run.close(out)
        yield _pairs(out)
        give_back()

    return sorted_rows.mapInArrow(meet, "a long, b long, star boolean").where("a <> b").groupBy("a", "b").agg(F.max("star").alias("star"))


def _pairs(out: list) -> pa.RecordBatch:
    a, b, star = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
    got = pd.DataFrame({"a": a, "b": b, "star": star}).drop_duplicates()
    return pa.RecordBatch.from_pandas(got, preserve_index=False)


def _overlapping(pairs: DataFrame, points: DataFrame) -> DataFrame:
    """The pairs (a, b) whose counts leave enough overlap; stars stay."""
    left = points.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("counts").alias("ca"))
    right = points.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("counts").alias("cb"))
    near = pairs.join(left, "a").join(right, "b")

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            keep = x["star"].to_numpy().copy()
            for (la, lb), own in x.groupby([x["ca"].str.len(), x["cb"].str.len()]).indices.items():
                groups = min(la, lb) // 2
                over = np.minimum(_points(x["ca"].iloc[own], groups), _points(x["cb"].iloc[own], groups)).sum(1)
                keep[own] |= over >= needed(x["na"].to_numpy()[own], x["nb"].to_numpy()[own])
            x = x[keep]
            yield x[["a", "b"]]

    return near.select("a", "b", "star", "na", "nb", "ca", "cb").mapInPandas(bound, "a long, b long")


class _Parts:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, these: np.ndarray) -> None:
        """Puts all the given positions into one part."""
        roots = np.unique(self.roots()[these])
        self.up[roots] = roots[0]


def _boxes(counts: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Leaves of an R-tree, packed by sorting on set size and then on the
    widest-spread counts in turn: positions, LEAF at most in each."""
    spread = np.argsort(-counts.std(0))[:2]
    order = np.lexsort((counts[:, spread[1]], counts[:, spread[0]] // 4, n // max(1, int(n.mean()) // 8)))
    return [order[i:i + LEAF] for i in range(0, len(order), LEAF)]


def _shared_codes(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each set as small numbers of those shingles that another set holds too."""
    _, code, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = held > 1
    number = np.cumsum(keep) - 1
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    return [number[c[keep[c]]] for c in np.split(code, cuts)], int(keep.sum())


def _link(sets: list[np.ndarray], counts: np.ndarray, n: np.ndarray, parts: _Parts, left: np.ndarray, right: np.ndarray) -> None:
    """Joins the parts of all linked pairs between positions ``left`` and
    ``right``. Boxes are compared first, then points, then the sets in full;
    pairs already in one part need no verifying."""
    counts = counts.astype(np.int32)
    codes, total = _shared_codes(sets)
    place = np.full(total, -1, np.int64)

    def rows_of(these: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(these), width), np.float32)
        for k, x in enumerate(these):
            at = place[codes[x]]
            out[k, at[at >= 0]] = 1
        return out

    trees = [(own, [own[leaf] for leaf in _boxes(counts[own], n[own])]) for own in (left, right)]
    tops = [np.array([counts[leaf].max(0) for leaf in t[1]]) for t in trees]
    lows = [np.array([n[leaf].min() for leaf in t[1]]) for t in trees]
    highs = [np.array([n[leaf].max() for leaf in t[1]]) for t in trees]
    for i, leaf in enumerate(trees[0][1]):
        over = np.minimum(tops[0][i], tops[1]).sum(1)
        near = (over >= needed(lows[0][i], lows[1])) & (100 * highs[1] >= SHARE * lows[0][i]) & (100 * highs[0][i] >= SHARE * lows[1])
        for j in np.flatnonzero(near):
            other = trees[1][1][j]
            roots = parts.roots()
            if len(np.unique(roots[np.concatenate([leaf, other])])) == 1:
                continue
            may = np.minimum(counts[leaf][:, None], counts[other][None]).sum(2) >= needed(n[leaf][:, None], n[other][None])
            may &= roots[leaf][:, None] != roots[other][None]
            if not may.any():
                continue
            rows, cols = leaf[may.any(1)], other[may.any(0)]
            used = np.unique(np.concatenate([codes[x] for x in rows]))
            place[used] = np.arange(len(used))
            same = np.rint(rows_of(rows, len(used)) @ rows_of(cols, len(used)).T).astype(np.int64)
            place[used] = -1
            linked = same >= needed(n[rows][:, None], n[cols][None])
            for k in np.flatnonzero(linked.any(1)):
                parts.join(np.append(cols[linked[k]], rows[k]))


def _work(jobs: DataFrame) -> DataFrame:
    """(a, b) links enough to join what links, from rows (job, side, gid, cls,
    part, n, set): within each job and group all of side 0 against all of side 1
    (or against itself). Rows of one part are known to be joined."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, g in x.groupby("gid", sort=False):
            g = g.sort_values(["n", "cls"]).reset_index(drop=True)
            sets = [np.frombuffer(s, np.uint64) for s in g["set"]]
            counts = np.stack([counts_of(s, groups_for(max(map(len, sets)))) for s in sets])
            n, side, cls = g["n"].to_numpy(np.int64), g["side"].to_numpy(), g["cls"].to_numpy()
            parts = _Parts(len(g))
            known = g.groupby("part", sort=False).indices
            for own in known.values():
                parts.join(own)
            before = parts.roots()
            zero, one = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if len(zero):
                _link(sets, counts, n, parts, zero, one if len(one) else zero)
            after = parts.roots()
            moved = np.unique(before[before != after[before]]) if len(before) else before
            a += cls[moved].tolist()
            b += cls[after[moved]].tolist()
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return jobs.groupBy("job").applyInPandas(run, "a long, b long")


def _sets_of(docs: DataFrame, members: DataFrame, reps: DataFrame) -> DataFrame:
    """(gid, cls, n, set) of the classes in groups, from the text of each class's first document."""
    ids = written(docs.sparkSession, members.join(reps, F.col("node") == F.col("cls")).select(
        F.col("rep").alias("k_id"), "cls", "gid", "size"), "join-members")
    few = broadcast_if_small(ids.select("k_id").distinct(), 16)
    texts = docs.join(few, F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi").select("text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [s for s in (shingle_set(words_of(t, lower=True)) for t in b.column(0).to_pylist()) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int64()),
                 pa.array([s.tobytes() for s in own], pa.binary())], ["cls", "n", "set"])
        give_back()

    got = texts.mapInArrow(sets, "cls long, n long, set binary")
    return got.join(ids.select("cls", "gid", "size"), "cls").select("gid", "size", "cls", "n", "set")


def _tiled(sets: DataFrame) -> DataFrame:
    """Rows with their tile: a number from 0 within the group, by bands of set size, then by hash."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / SHARE)))).cast("int")
    s = sets.withColumn("band", F.when(F.col("size") > TILE, band).otherwise(0))
    per = s.groupBy("gid", "band").agg(F.count("*").alias("here")).withColumn("tiles", F.ceil(F.col("here") / TILE).cast("int"))
    before = Window.partitionBy("gid").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("first", F.coalesce(F.sum("tiles").over(before), F.lit(0)).cast("int"))
    return s.join(per.drop("here"), ["gid", "band"]).withColumn(
        "tile", (F.col("first") + F.pmod(F.xxhash64("cls"), F.col("tiles"))).cast("int")).drop("first", "tiles")


def _small_jobs(sets: DataFrame, n_rows: int) -> DataFrame:
    """Groups of a tile or less, several to a job."""
    jobs = max(1, n_rows // (2 * TILE))
    return sets.where(F.col("size") <= TILE).withColumn(
        "job", F.concat(F.lit("s"), F.pmod(F.xxhash64("gid"), F.lit(jobs)).cast("string"))).select(
        "job", F.lit(0).alias("side"), "gid", "cls", F.col("cls").alias("part"), "n", "set")


def _tile_jobs(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows of both tiles of each pair (gid, i, j); i = j is one tile against itself."""
    named = pairs.withColumn("job", F.concat_ws("-", "gid", "i", "j"))
    one = named.select("job", "gid", F.col("i").alias("tile"), F.lit(0).alias("side"))
    two = named.where("i <> j").select("job", "gid", F.col("j").alias("tile"), F.lit(1).alias("side"))
    return tiles.join(one.unionByName(two), ["gid", "tile"]).select("job", "side", "gid", "cls", "part", "n", "set")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, cls, n) of every row, and links (a, b) between classes that make up all components."""
    spark = docs.sparkSession
    own = keep_columns(docs, {"doc_id": "long", "text": "string"})
    signed = written(spark, signatures(own, common_shingles(own)), "join-signatures")
    classed = signed.where(F.col("cls").isNotNull())
    dealt = classed.select(F.posexplode("first").alias("at", "s"), "cls", "n").select(
        "s", "cls", (F.shiftleft("n", 32) + F.col("n") - F.col("at")).alias("size")).repartition("s").sortWithinPartitions("s", "cls")
    met = written(spark, _meetings(dealt), "join-meetings")
    reps = classed.groupBy("cls").agg(F.min("doc_id").alias("rep"))
    points = classed.select("cls", "n", "counts").dropDuplicates(["cls"])
    groups = components(_overlapping(met, points))
    sizes = groups.groupBy("component").agg(F.count("*").alias("size"))
    members = groups.join(sizes, "component").select("node", F.col("component").alias("gid"), "size")
    sets = written(spark, _sets_of(own, members, reps), "join-sets")
    n_rows = members.count()
    found = [written(spark, _work(_small_jobs(sets, n_rows)), "join-links")]
    large = sets.where(F.col("size") > TILE)
    if not large.isEmpty():
        tiles = written(spark, _tiled(large), "join-tiles")
        found += _large_links(spark, tiles)
    return signed.select("doc_id", "text_hash", "cls", "n"), _union(found)


def _union(dfs: list[DataFrame]) -> DataFrame:
    out = dfs[0]
    for x in dfs[1:]:
        out = out.unionByName(x)
    return out


def _large_links(spark, tiles: DataFrame) -> list[DataFrame]:
    """Links within groups above a tile's size, in the two passes of step 4."""
    seen = tiles.select("gid", "tile", "band").distinct()
    alone = seen.select("gid", F.col("tile").alias("i"), F.col("tile").alias("j"))
    # the first tile of a band also meets the other tiles of its band and the first ones of the next
    heads = seen.groupBy("gid", "band").agg(F.min("tile").alias("i"))
    of_band = seen.join(heads, ["gid", "band"]).where(F.col("tile") != F.col("i")).select("gid", "i", F.col("tile").alias("j"))
    following = heads.select("gid", (F.col("band") - 1).alias("band"), F.col("i").alias("j")).join(heads, ["gid", "band"]).select("gid", "i", "j")
    start = _union([alone, of_band, following])
    first = written(spark, _work(_tile_jobs(tiles.withColumn("part", F.col("cls")), start)), "join-links")
    parts = components(first)
    named = tiles.join(parts.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn(
        "part", F.coalesce("component", "cls")).drop("component")
    named = written(spark, named, "join-parts")
    main = named.groupBy("gid", "part").agg(F.count("*").alias("rows")).groupBy("gid").agg(
        F.max(F.struct("rows", "part")).alias("top")).select("gid", F.col("top.part").alias("main"))
    rest = named.join(main, "gid").where(F.col("part") != F.col("main")).drop("main")
    per = rest.groupBy("gid", "band").agg(F.count("*").alias("here"))
    # what is left, in tiles of its own by band (numbered below 0), against all tiles of its band and the two beside it
    left = rest.join(per, ["gid", "band"]).withColumn("own", (-1 - (
        F.col("band") * 1_000_000 + F.pmod(F.xxhash64("cls"), F.ceil(F.col("here") / TILE)))).cast("long")).drop("here")
    left = written(spark, left.drop("tile").withColumnRenamed("own", "tile"), "join-rest")
    if left.isEmpty():
        return [first]
    lt = left.select("gid", F.col("tile").alias("i"), F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band")).distinct()
    against = lt.join(seen, ["gid", "band"]).select("gid", "i", F.col("tile").alias("j")).distinct()
    both = named.select("gid", F.col("tile").cast("long").alias("tile"), "cls", "part", "n", "set").unionByName(
        left.select("gid", "tile", "cls", "part", "n", "set"))
    return [first, written(spark, _work(_tile_jobs(both, against)), "join-links")]


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and component (null without
    shingles) of every row; components of different texts that share their
    smallest id have one component_id, but each its own component."""
    rows, found = links(docs)
    reps = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("rep"))
    joined = components(found)
    named = reps.join(joined, F.col("cls") == F.col("node"), "left").select(
        "cls", "rep", F.coalesce("component", "cls").alias("component"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "component").select("cls", "component", "component_id")
    shown = ["doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "component"]
    return rows.where(F.col("cls").isNotNull()).join(named, "cls").select(*shown).unionByName(
        rows.where(F.col("cls").isNull()).withColumn("component_id", F.col("doc_id")).withColumn(
            "component", F.lit(None).cast("long")).select(*shown))


def with_component(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return _placed(docs).select("doc_id", "n_shingles", "component_id")


@shielded("doc_id", "text")
def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id
    (of equal ids the one with the smallest hash of its text, of equal rows
    any one); documents without id stay. Rows are told apart by id and text."""
    spark = docs.sparkSession
    found = written(spark, _placed(docs), "join-components")
    first = written(spark, found.where(F.col("doc_id") == F.col("component_id")).groupBy(
        F.col("doc_id").alias("k_id"), F.col("component").alias("k_component")).agg(
        F.min("text_hash").alias("k_hash"), F.max("text_hash").alias("last"), F.count("*").alias("rows")).where("rows > 1"), "join-first")
    several = first.where("k_hash <> last").select("k_id", "k_component", F.col("k_hash").alias("least"))
    others = found.join(broadcast_if_small(several, 24), (F.col("doc_id") == F.col("k_id")) & F.col("component").eqNullSafe(F.col("k_component"))).where(
        F.col("text_hash") != F.col("least"))
    gone = written(spark, found.where(F.col("doc_id") != F.col("component_id")).unionByName(others.select(*found.columns)).select(
        F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct(), "join-gone")
    same = (F.col("doc_id").cast("long") == F.col("k_id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("k_hash"))
    kept = docs.join(broadcast_if_small(gone, 24), same, "left_anti")
    again = first.select("k_id", "k_hash")
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again, 24)
    return kept.join(again, same, "left_anti").unionByName(
        kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def query(spark, sf_dir) -> DataFrame:
    return with_component(table(spark, sf_dir, "documents"))
