"""HTML extraction by wrapper induction.

Pages of a host share a few templates. The shapes of all pages' trees are
counted per host, and each shape that makes up FREQUENT of a host's pages has
one of them as its reference. Every page is aligned, by simple tree matching,
with the reference of its own shape, or else with the one of the host's
commonest shape, and each pair of aligned nodes votes: equal text is template,
varying text is content. Votes of all pages are summed per host and reference
by Spark. They name the content slot (the smallest container that holds most
of the varying text) and the constant nodes. A page's main text is what its
content slot holds, without furniture (menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) and constants; a page
whose slot is not there, or is the whole page, falls back on its own articles,
all outermost ones in order, or on the container with most of its text.

Defined results: a null, empty or markup-only page has the empty text; a page
without url belongs to the host ''; equal rows vote and are extracted each; a
page cut off anywhere, or nested to any depth, is read as far as it goes; an
empty table gives no rows; other columns pass through untouched."""

from __future__ import annotations

from collections import Counter, OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespanel.llm.common import BROADCAST_BYTES, shielded, table, written
from salespanel.llm.page_tree import FURNITURE_WORDS, Node, Slot, align, blocks, compress, parse, shape
from salespanel.llm.page_tree import slots as _slots

#: A container takes part of the slot from its parent if it holds so much of the varying text.
SHARE = 0.7
#: A node is constant if it is equal on so much of at least so many aligned pages.
CONSTANT, CONSTANT_PAGES = 0.9, 5
#: A shape with so much of a host's pages has a reference of its own.
FREQUENT = 0.05


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1), F.lit("")))


class _References(OrderedDict):
    """Compressed reference trees by host and shape, the latest few hundred."""

    def of(self, host: str, shape_: int, html: str) -> Slot:
        key = (host, shape_)
        if key not in self:
            self[key] = compress(parse(html))
            if len(self) > 500:
                self.popitem(last=False)
        return self[key]


def _fitting(refs, own: int):
    """Of a host's references, commonest first, the one of a page's own shape, or the first."""
    return next((r for r in refs if r["shape"] == own), refs[0])


def content_slot(root: Slot, mass: Counter) -> Slot:
    """From the root down into the container that holds most of the mass, as long as one does."""
    whole: dict = {}
    for s in reversed(_slots(root)):  # children before their parents
        whole[s.number] = mass[s.number] + sum(whole[c.number] for c in s.children)
    at = root
    while True:
        below = [c for c in at.children if c.children and whole[c.number] >= SHARE * whole[at.number]]
        if not below or not whole[at.number]:
            return at
        at = max(below, key=lambda c: whole[c.number])


def own_text(slot: Slot) -> int:
    """Characters of a slot that none of its children's slots have."""
    if slot.children:
        return sum(len(x) for n in slot.nodes for x in n.children if isinstance(x, str) and x.strip())
    return sum(len(x) for n in slot.nodes for x in blocks(n, Node.is_furniture))


def _shapes(pages: DataFrame) -> DataFrame:
    """(host, shape, pages, key) from pages (host, html, key): how many pages of
    a host have each shape, and the least key of one; shapes of a page without
    any block don't count."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            seen, least = Counter(), {}
            for host, html, key in zip(x["host"], x["html"], x["key"], strict=True):
                own, n = shape(compress(parse(html)))
                if n > 1:
                    seen[host, own] += 1
                    least[host, own] = min(key, least.get((host, own), key))
            yield pd.DataFrame([(h, s, seen[h, s], least[h, s]) for h, s in seen], columns=["host", "shape", "pages", "key"])

    return pages.mapInPandas(count, "host string, shape long, pages long, key long").groupBy("host", "shape").agg(
        F.sum("pages").alias("pages"), F.min("key").alias("key"))


def _frequent(shapes: DataFrame) -> DataFrame:
    """The shapes of FREQUENT of a host's pages, and its commonest one (the least of equals): at most 1 / FREQUENT + 1 a host."""
    per = shapes.groupBy("host").agg(F.sum("pages").alias("all"), F.max(F.struct("pages", (-F.col("shape")).alias("least"))).alias("top")).select(
        "host", "all", (-F.col("top.least")).alias("top"))
    return shapes.join(per, "host").where((F.col("pages") >= FREQUENT * F.col("all")) | (F.col("shape") == F.col("top"))).select(
        "host", "shape", "pages", "key")


def _votes(pages: DataFrame) -> DataFrame:
    """(host, shape, node, pages, equal, mass) from pages (host, html, refs)."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        references = _References()
        for x in batches:
            seen, equal, mass = Counter(), Counter(), Counter()
            for host, html, refs in zip(x["host"], x["html"], x["refs"], strict=True):
                tree = compress(parse(html))
                own, n = shape(tree)
                if n < 2:
                    continue
                ref = _fitting(refs, own)
                for r, s in align(references.of(host, ref["shape"], ref["ref"]), tree):
                    at = (host, ref["shape"], r.number)
                    seen[at] += 1
                    if not r.children and not s.children and r.text() == s.text():
                        equal[at] += 1
                    else:
                        mass[at] += own_text(s)
            yield pd.DataFrame([(*at, seen[at], equal[at], mass[at]) for at in seen],
                               columns=["host", "shape", "node", "pages", "equal", "mass"])

    kind = "host string, shape long, node int, pages long, equal long, mass long"
    return pages.mapInPandas(vote, kind).groupBy("host", "shape", "node").agg(
        F.sum("pages").alias("pages"), F.sum("equal").alias("equal"), F.sum("mass").alias("mass"))


def _wrappers(votes: DataFrame, refs: DataFrame) -> DataFrame:
    """(host, shape, pages, ref, slot, constant): per reference the number of its content slot (-1: the whole page) and of its constant nodes."""

    def induce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            found, constants = [], []
            for ref, votes in zip(x["ref"], x["votes"], strict=True):
                v = [(int(r["node"]), r["pages"], r["equal"], r["mass"]) for r in votes]
                fixed = {n for n, p, e, _ in v if p >= CONSTANT_PAGES and e >= CONSTANT * p}
                mass = Counter({n: m for n, _, _, m in v if n not in fixed})
                at = content_slot(compress(parse(ref)), mass)
                found.append(-1 if at.label[0] in ("#page", "html", "body") else at.number)
                constants.append(sorted(fixed))
            yield x[["host", "shape", "pages", "ref"]].assign(slot=found, constant=constants)

    per = votes.groupBy("host", "shape").agg(F.collect_list(F.struct("node", "pages", "equal", "mass")).alias("votes"))
    return refs.join(per, ["host", "shape"]).mapInPandas(induce, "host string, shape long, pages long, ref string, slot int, constant array<int>")


def _by_host(rows: DataFrame, *columns: str) -> DataFrame:
    """(host, refs): the references of a host, commonest first."""
    order = F.struct((-F.col("pages")).alias("rank"), "shape", *columns)
    return rows.groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("refs"))


def _articles(root: Node) -> list[Node]:
    """Outermost articles (or mains) that are no furniture."""
    for tag in ("article", "main"):
        out, stack = [], [root]
        while stack:
            n = stack.pop()
            if n.tag == tag:
                out.append(n)
            elif not n.is_furniture():
                stack += [c for c in reversed(n.children) if isinstance(c, Node)]
        if out:
            return [n for n in out if not n.words & FURNITURE_WORDS] or out
    return []


def main_text(html: str | None, host: str = "", refs=(), references: _References | None = None) -> str:
    """The main text of a page, by its host's wrappers or on its own."""
    root = parse(html)
    tree = compress(root)
    content, fixed = [], set()
    if len(refs):
        ref = _fitting(refs, shape(tree)[0])
        constant = set(ref["constant"])
        pairs = align((references if references is not None else _References()).of(host, ref["shape"], ref["ref"]), tree)
        fixed = {id(n) for r, s in pairs if r.number in constant and r.text() == s.text() for n in s.nodes}
        content = [n for r, s in pairs if r.number == ref["slot"] for n in s.nodes]
    if not content or content[0].holds_article and content[0].tag not in ("article", "main"):
        content = _articles(root) or content or content_slot(tree, Counter({s.number: own_text(s) for s in _slots(tree)})).nodes
    skip = lambda n: n.is_furniture() or id(n) in fixed
    out = [x for n in content for x in blocks(n, skip)]
    return "\n".join(out or [x for n in content for x in blocks(n, Node.is_furniture)])


@shielded("page_id", "url", "html")
def with_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` and a column _text with the main text of each page."""
    spark = pages.sparkSession
    own = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"),
                       F.xxhash64("page_id", F.coalesce("html", F.lit(""))).alias("key"))
    counted = written(spark, _shapes(own), "wrapper-counts")
    frequent = written(spark, _frequent(counted), "wrapper-shapes")
    few = F.broadcast(frequent) if frequent.count() * 96 <= BROADCAST_BYTES else frequent
    refs = written(spark, own.join(few, ["host", "key"]).dropDuplicates(["host", "shape"]).select(
        "host", "shape", "pages", F.col("html").alias("ref")), "wrapper-references")
    votes = _votes(own.join(_hinted(written(spark, _by_host(refs, "ref"), "wrapper-hosts")), "host").select("host", "html", "refs"))
    wrappers = _wrappers(written(spark, votes, "wrapper-votes"), refs)
    wrappers = _hinted(written(spark, _by_host(wrappers, "ref", "slot", "constant"), "wrappers"))

    @F.pandas_udf("string")
    def extract(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        references = _References()
        for hosts, htmls, known in parts:
            yield pd.Series([main_text(h, host, () if r is None else r, references)
                             for host, h, r in zip(hosts, htmls, known, strict=True)], dtype=object)

    names = pages.columns
    return pages.withColumn("host", host_of(F.col("url"))).join(wrappers, "host", "left").withColumn(
        "_text", extract("host", "html", "refs")).select(*names, "_text")


def _hinted(df: DataFrame) -> DataFrame:
    """(host, refs), a written table, with a broadcast hint if its texts fit the limit."""
    size = df.agg(F.coalesce(F.sum(F.aggregate("refs", F.lit(200).cast("long"), lambda n, r: n + F.octet_length(r["ref"]) + 200)), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def query(spark, sf_dir) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return with_main_text(pages).select("page_id", "url", F.col("_text").alias("text"),
                                        F.char_length("_text").cast("long").alias("n_chars"))
