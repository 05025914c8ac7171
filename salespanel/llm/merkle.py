"""Merkle manifest of a dataset: a postorder append log of hashed runs of eight.

Every row is a leaf, the sha256 of its columns with their lengths. The leaves
of a language, in ascending order of doc_id, make one tree: while more than
one node remains, every eight consecutive ones (the last run may be shorter,
down to one) become the hash of their joined digests. The languages' subroots,
in order, make the tree above them in the same way.

Builders take aligned blocks of 8^4 consecutive nodes and write what they
complete in the order of completion. In a tree of n leaves, a node's place in
that log follows from subtree sizes alone: when node j of height h is
complete, so are all nodes of its height and below over the leaves up to its
last one, and those above whose leaves all lie before it (``position``). Proofs
find siblings by these places. A block's builder or reader needs its own nodes
only, whatever the size of its language.

Ranks come from one range partitioned sort and the counts of its partitions,
so no task orders a whole language.

Defined results: a null column is hashed as ``-``; null ids and null languages
come first; rows of an id are ordered by their leaves, and repeated rows are
leaves of their own; an empty table has no leaves, no log and no root; other
columns of the input don't matter."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salespanel.llm.common import broadcast_if_small, keep_columns, table, written

#: A run is 2^RUN_BITS nodes; a block reaches over this many heights.
RUN_BITS, BLOCK_HEIGHTS = 3, 4
BLOCK_BITS = RUN_BITS * BLOCK_HEIGHTS
COLUMNS = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The name of the tree over the subroots; a language's tree is ``=`` and its name, the null one's ``-``, which sorts first.
TOP = ""
#: Reckoned bytes of a row of the partition counts.
COUNT_BYTES = 128


def joined_hash(digests: str) -> str:
    return hashlib.sha256(digests.encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    """The leaf of a row of COLUMNS that has this text."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def tree_of(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


def height_of(n: int) -> int:
    """The height of a tree of n leaves."""
    h = 0
    while n > 1:
        n, h = -(-n >> RUN_BITS), h + 1
    return h


def width(n: int, h: int) -> int:
    """How many nodes of height h a tree of n leaves has."""
    return -(-n >> RUN_BITS * h)


def position(n: int, h: int, j: np.ndarray) -> np.ndarray:
    """The places in the log of the nodes j of height h, in a tree of n leaves."""
    j = np.asarray(j, np.int64)
    end = np.minimum(j + 1 << RUN_BITS * h, n)
    done = sum(-(-end >> RUN_BITS * i) for i in range(h + 1))
    return done + sum(j >> RUN_BITS * (i - h) for i in range(h + 1, height_of(n) + 1)) - 1


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows (a written table with ``tree``) with their index in their tree
    by ``order`` and the number n of its rows. Equal rows may lie in any partition."""
    spark = rows.sparkSession
    # a repeated row must not fill one partition, so the place it was read at is the last key
    keys = [F.col("tree"), *[F.col(c).asc_nulls_first() for c in order]]
    placed = rows.withColumn("_read", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys, F.col("_read")).sortWithinPartitions(*keys, "_read").drop("_read")
    placed = written(spark, placed.withColumn("at", F.monotonically_increasing_id()), "merkle-placed")
    part = F.shiftright("at", 33)  # the partition that wrote the row
    counts = placed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    by_part = Window.partitionBy("tree").orderBy("part")
    counts = counts.select(
        "tree", "part", (F.sum("held").over(by_part) - F.col("held") - F.col("first")).alias("shift"),
        F.sum("held").over(Window.partitionBy("tree")).alias("n"))
    counts = broadcast_if_small(written(spark, counts, "merkle-counts"), COUNT_BYTES)
    return placed.withColumn("part", part).join(counts, ["tree", "part"]).withColumn("index", F.col("at") + F.col("shift")).drop(
        "at", "part", "shift")


LOG = "tree string, n long, height int, index long, position long, node string"


def _complete(block: pd.DataFrame) -> pd.DataFrame:
    """All nodes over a block, leaves included, in the order of completion."""
    block = block.sort_values("index")
    tree, n, base = block["tree"].iloc[0], int(block["n"].iloc[0]), int(block["height"].iloc[0])
    nodes, first, top = block["node"].tolist(), int(block["index"].iloc[0]), height_of(n)
    found = [(0, first, nodes)] if base == 0 else []
    for h in range(base + 1, min(base + BLOCK_HEIGHTS, top) + 1):
        nodes = [joined_hash("".join(nodes[k:k + 8])) for k in range(0, len(nodes), 1 << RUN_BITS)]
        first >>= RUN_BITS
        found.append((h, first, nodes))
    parts = []
    for h, first, nodes in found:
        index = np.arange(first, first + len(nodes))
        parts.append(pd.DataFrame({"tree": tree, "n": n, "height": h, "index": index, "position": position(n, h, index), "node": nodes}))
    return pd.concat(parts).sort_values("position")


def append_log(leaves: DataFrame) -> DataFrame:
    """The log of every tree (written): tree, n, height, index, position, node.
    ``leaves`` are tree, n, index and node. A round builds four heights."""
    spark = leaves.sparkSession
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select("tree", "n", F.lit(0).alias("height"), "index", "node")
    log, base = None, 0
    while True:
        built = nodes.groupBy("tree", F.shiftright("index", BLOCK_BITS).alias("block")).applyInPandas(_complete, LOG)
        built = written(spark, built, "merkle-log")
        log = built if log is None else log.unionByName(built)
        base += BLOCK_HEIGHTS
        if height_of(most) <= base:
            return log
        nodes = built.where((F.col("height") == base) & (F.col("n") > 1 << RUN_BITS * base)).drop("position")


def roots(log: DataFrame) -> DataFrame:
    """(tree, n, node): the last node of every tree's log."""
    last = F.max_by("node", "position").alias("node")
    return log.groupBy("tree").agg(F.first("n").alias("n"), last)


class Runs:
    """The runs over one block's nodes, read from its part of the log. A run is
    written as its digests joined, with ``*`` in the place of the asking node."""

    def __init__(self, log: pd.DataFrame):
        self.n, self.low = int(log["n"].iloc[0]), int(log["height"].min()) // BLOCK_HEIGHTS * BLOCK_HEIGHTS
        self.top = min(self.low + BLOCK_HEIGHTS, height_of(self.n))
        log = log.sort_values("position")
        self.position, self.node = log["position"].to_numpy(np.int64), log["node"].tolist()
        self.runs: dict[tuple[int, int], list[str]] = {}

    def run(self, h: int, first: int) -> list[str]:
        if (h, first) not in self.runs:
            beside = np.arange(first, min(first + (1 << RUN_BITS), width(self.n, h)))
            at = np.searchsorted(self.position, position(self.n, h, beside))
            self.runs[h, first] = [self.node[k] for k in at]
        return self.runs[h, first]

    def path(self, j: int) -> list[str]:
        """The runs from node j of the block's lowest height up."""
        out = []
        for h in range(self.low, self.top):
            first = j >> RUN_BITS << RUN_BITS
            nodes = self.run(h, first)
            out.append("".join([*nodes[:j - first], "*", *nodes[j - first + 1:]]))
            j >>= RUN_BITS
        return out


def folded(path: list[str], node: str) -> str:
    """The root that a node and its runs lead to."""
    for run in path:
        node = joined_hash(run.replace("*", node))
    return node


PATHS = "tree string, index long, node string, path array<string>, root string"


def _block_paths(key, log: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
    """The whole path of each of the lowest nodes of a block."""
    runs, up = Runs(log), list(above["path"].iloc[0])
    own = log[log["height"] == runs.low]
    return pd.DataFrame({"tree": key[0], "index": own["index"].to_numpy(), "node": own["node"].to_numpy(),
                         "path": [runs.path(j) + up for j in own["index"].tolist()], "root": above["root"].iloc[0]})


def _segment(log: DataFrame, group: int) -> DataFrame:
    """The rows of the log between two blocks' roots, with the block they belong to."""
    low = group * BLOCK_HEIGHTS
    block = F.expr(f"shiftright(index, {RUN_BITS} * ({low + BLOCK_HEIGHTS} - height))")
    return log.where(F.col("height").between(low, low + BLOCK_HEIGHTS - 1)).withColumn("block", block)


def block_paths(log: DataFrame, tops: DataFrame) -> DataFrame:
    """For every aligned block of leaves, the path of its root to the dataset's
    (written): tree, index (the block's), path, root. ``tops`` give each tree's
    path above its own root and the root at the end: tree, n, path, root.
    Goes from the top down, a path a block, never one a leaf."""
    spark = log.sparkSession
    highest = F.expr("aggregate(sequence(1, 21), 0, (h, i) -> if(n > shiftleft(1L, 3 * (i - 1)), i, h))")
    tops = tops.withColumn("group", F.floor(highest / BLOCK_HEIGHTS).cast("int"))
    group, above = tops.agg(F.max("group")).first()[0], None
    while True:
        own = tops.where(F.col("group") == group).select("tree", F.lit(0).cast("long").alias("index"), "path", "root")
        above = own if above is None else above.select("tree", "index", "path", "root").unionByName(own)
        above = written(spark, above, "merkle-paths")
        if group == 0:
            return above
        above = _segment(log, group).groupBy("tree", "block").cogroup(above.groupBy("tree", "index")).applyInPandas(_block_paths, PATHS)
        group -= 1


def leaf_paths(log: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every leaf's proof: tree, index, node, path (its runs up to the dataset's root), root."""
    return _segment(log, 0).groupBy("tree", "block").cogroup(blocks.groupBy("tree", "index")).applyInPandas(_block_paths, PATHS)


@dataclass
class Manifest:
    """The trees of a dataset: its ranked leaves, their log, the log of the
    tree over the subroots, and the tops of ``block_paths``. All written."""

    leaves: DataFrame
    log: DataFrame
    top_log: DataFrame
    tops: DataFrame

    def root(self) -> str | None:
        row = roots(self.top_log).first()
        return row.node if row else None


def manifest(docs: DataFrame, *carried: Column) -> Manifest | None:
    """The manifest of a table with COLUMNS, None if it is empty. ``carried``
    expressions over them stay with the leaves, the text does not."""
    spark = docs.sparkSession
    own = keep_columns(docs, COLUMNS)
    leaves = written(spark, own.select(tree_of(F.col("lang")).alias("tree"), "doc_id", leaf_hash(F.col("text")).alias("node"), *carried), "merkle-leaves")
    if leaves.isEmpty():
        return None
    leaves = ranked(leaves, ["doc_id", "node"])
    log = append_log(leaves)
    subroots = written(spark, roots(log).select(F.lit(TOP).alias("tree"), F.col("tree").alias("of"), F.col("n").alias("leaves"), "node"), "merkle-subroots")
    subroots = ranked(subroots, ["of"])
    top_log = append_log(subroots)
    apex = roots(top_log).select("tree", "n", F.array().cast("array<string>").alias("path"), F.col("node").alias("root"))
    paths = leaf_paths(top_log, block_paths(top_log, apex)).select("index", "path", "root")
    tops = subroots.join(paths, "index").select(F.col("of").alias("tree"), F.col("leaves").alias("n"), F.col("node").alias("subroot"), "path", "root")
    return Manifest(leaves, log, top_log, written(spark, tops, "merkle-tops"))


PROOFS = ("doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
          "tree string, index long, position long")


def _check(key, known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
    """Proofs of a block's leaves, folded from the claimed ones. ``known`` is
    the block's log and one row that has the path above it."""
    above = known[known["root"].notna()].iloc[0]
    runs, up = Runs(known[known["root"].isna()]), list(above["path"])
    out = []
    for doc_id, index, leaf, claimed in zip(asked["doc_id"], asked["index"], asked["node"], asked["claimed"]):
        path = runs.path(index) + up
        out.append((doc_id, leaf, above["subroot"], above["root"], joined_hash("".join(path).replace("*", "")), folded(path, claimed), key[0], index))
    made = pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "tree", "index"])
    made["position"] = position(runs.n, 0, made["index"].to_numpy())
    return made


def checked(m: Manifest) -> DataFrame:
    """The proof of every leaf, folded from its ``claimed`` digest (a carried column)."""
    blocks = block_paths(m.log, m.tops).join(m.tops.select("tree", "subroot"), "tree")
    log = _segment(m.log, 0).select("tree", "block", "n", "height", "position", "node")
    none = {"n": "long", "height": "int", "position": "long", "node": "string"}
    known = log.withColumns({"path": F.lit(None).cast("array<string>"), "root": F.lit(None).cast("string"), "subroot": F.lit(None).cast("string")}).unionByName(
        blocks.select("tree", F.col("index").alias("block"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()], "path", "root", "subroot"))
    asked = m.leaves.select("tree", F.shiftright("index", BLOCK_BITS).alias("block"),
                             F.col("doc_id").cast("string"), "index", "node", "claimed")  # as text, null ids leave the others exact
    found = known.groupBy("tree", "block").cogroup(asked.groupBy("tree", "block")).applyInPandas(_check, PROOFS)
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def tampered(doc_id: Column) -> Column:
    """Whether 3 divides the crc32 of the id's digits; a null id is never tampered with."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def query(spark, sf_dir) -> DataFrame:
    lowered = leaf_hash(F.when(tampered(F.col("doc_id")), F.translate("text", UPPER, LOWER)).otherwise(F.col("text")))
    m = manifest(table(spark, sf_dir, "documents"), lowered.alias("claimed"))
    if m is None:
        return spark.createDataFrame([], PROOFS.replace("doc_id string", "doc_id long") + ", verified boolean")
    return checked(m).withColumn("verified", F.col("folded_root") == F.col("root"))


def _oracle(heights: int = 8, top_heights: int = 4) -> str:
    """SQL by levels: runs over row numbers, each node with what lies left and
    right of it in its run. Covers 8^heights rows a language."""
    field_sql = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    beside = ("coalesce(string_agg(node, '') OVER (PARTITION BY tree, i // 8 ORDER BY i ROWS BETWEEN {}), '')")
    ctes = [
        # the CRC-32 table from its reversed polynomial, and the checksum of the id's digits
        "crc_table AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], [0, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)",
        "marked AS (SELECT *, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: "
        "CAST(ascii(d) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, crc_table)",
        f"given AS (SELECT coalesce('=' || lang, '-') AS tree, doc_id, {leaf('text')} AS leaf, "
        f"{leaf('lowered')} AS claimed FROM (SELECT *, CASE WHEN doc_id IS NOT NULL AND crc % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS lowered FROM marked))",
        "l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM given)",
        "n0 AS (SELECT tree, i, leaf AS node FROM l)"]

    def levels(n: str, r: str, count: int) -> None:
        for h in range(1, count + 1):
            ctes.append(f"{r}{h} AS (SELECT tree, i, node, count(*) OVER (PARTITION BY tree) AS n, "
                        f"{beside.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS before, "
                        f"{beside.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS behind FROM {n}{h - 1})")
            ctes.append(f"{n}{h} AS (SELECT tree, i // 8 AS i, sha256(string_agg(node, '' ORDER BY i)) AS node FROM {r}{h} WHERE n > 1 "
                        f"GROUP BY tree, i // 8 UNION ALL SELECT tree, i, node FROM {r}{h} WHERE n = 1)")

    levels("n", "r", heights)
    ctes.append(f"subroots AS (SELECT tree AS lang_tree, node, row_number() OVER (ORDER BY tree) - 1 AS i FROM n{heights})")
    ctes.append("t0 AS (SELECT '' AS tree, i, node FROM subroots)")
    levels("t", "q", top_heights)
    ctes.append("f0 AS (SELECT l.*, s.node AS subroot, s.i AS s, claimed AS f, '' AS proof FROM l JOIN subroots s ON l.tree = s.lang_tree)")
    steps = [(f"r{h}", f"f.tree = r.tree AND f.i // {8 ** (h - 1)} = r.i") for h in range(1, heights + 1)]
    steps += [(f"q{h}", f"f.s // {8 ** (h - 1)} = r.i") for h in range(1, top_heights + 1)]
    for k, (runs, on) in enumerate(steps, 1):
        ctes.append(f"f{k} AS (SELECT f.* EXCLUDE (f, proof), CASE WHEN r.n > 1 THEN sha256(before || f.f || behind) ELSE f.f END AS f, "
                    f"proof || CASE WHEN r.n > 1 THEN before || behind ELSE '' END AS proof FROM f{k - 1} f JOIN {runs} r ON {on})")
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, "
            f"f = root AS verified, tree, i AS index, i + CAST(" + " + ".join(f"(i >> {3 * h})" for h in range(1, heights + 1)) +
            f" AS BIGINT) AS position FROM f{len(steps)}, (SELECT node AS root FROM t{top_heights})")


ORACLE = _oracle()
