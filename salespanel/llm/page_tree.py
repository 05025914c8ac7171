"""A forgiving HTML tree, small enough to align: elements, their text, and
runs of like siblings as one repeated node."""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass, field

import xxhash

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[/a-zA-Z!]?\Z", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg".split())
#: Elements that begin a block of text of their own.
BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
    "thead tr ul").split())
#: Blocks of running text; a word of their class doesn't make them furniture.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt figcaption caption td th".split())
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())
_CLOSED_BY_SIBLING = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
#: Page furniture, by element, by role, and by a word of a class or id.
FURNITURE = frozenset("nav header footer aside form script style noscript template iframe button select textarea dialog menu head title svg".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu toolbar".split())
FURNITURE_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer header masthead topbar cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login share sharing social related recommended comment comments commentlist reply "
    "replies respond disqus widget toolbar pagination pager skip copyright legal search").split())


@dataclass
class Node:
    tag: str
    words: frozenset = frozenset()
    role: str = ""
    hidden: bool = False
    children: list = field(default_factory=list)  # of Node and str
    holds_article: bool = False  # itself or below

    @property
    def label(self) -> tuple:
        return (self.tag, self.words)

    def is_furniture(self) -> bool:
        if self.tag in ("html", "body", "article", "main"):
            return self.hidden
        return (self.hidden or self.tag in FURNITURE or self.role in FURNITURE_ROLES
                or bool(self.words & FURNITURE_WORDS) and self.tag not in TEXT_BLOCKS and not self.holds_article)


def walk(node: Node):
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        stack += [c for c in reversed(x.children) if isinstance(c, Node)]


def _read(attributes: str) -> tuple[frozenset, str, bool]:
    """Words of class and id, role, and whether it is hidden."""
    got = {}
    for m in _ATTRIBUTE.finditer(attributes):
        got.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
    words = frozenset(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{got.get('class', '')} {got.get('id', '')}").lower()))
    style = got.get("style", "").replace(" ", "").lower()
    return words, got.get("role", "").lower(), "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in style


_read_again = functools.lru_cache(4096)(_read)  # a site's pages repeat the same short ones


def _element(tag: str, attributes: str) -> Node:
    if not attributes:
        return Node(tag)
    return Node(tag, *(_read_again if len(attributes) <= 256 else _read)(attributes))


def parse(text: str | None) -> Node:
    """The tree of a page, whole or cut off anywhere; end tags may be missing."""
    text = text or ""
    root = Node("#page")
    stack, at = [root], 0
    open_at: dict[str, list[int]] = {}  # tag -> places in the stack
    blocks_at: list[int] = []

    def cut(place: int) -> None:
        while len(stack) > place:
            tag = stack.pop().tag
            open_at[tag].pop()
            if tag in BLOCKS:
                blocks_at.pop()

    def last(tag: str) -> int:
        return open_at[tag][-1] if open_at.get(tag) else -1

    while True:
        m = _TOKEN.search(text, at)
        chunk = text[at:m.start() if m else len(text)]
        if chunk:
            stack[-1].children.append(html.unescape(chunk))
        if m is None:
            return root
        at = m.end()
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if end:
            if last(tag) > 0:
                cut(last(tag))
            continue
        if tag in BLOCKS and last("p") > 0 and blocks_at[-1] == last("p"):
            cut(last("p"))  # a block ends an open paragraph
        elif tag in _CLOSED_BY_SIBLING and last(tag) > max(map(last, _CLOSED_BY_SIBLING[tag])):
            cut(last(tag))
        node = _element(tag, attributes)
        stack[-1].children.append(node)
        if tag in ("article", "main"):
            node.holds_article = True
            for above in reversed(stack):
                if above.holds_article:
                    break
                above.holds_article = True
        if tag in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(text, at)
            at = close.end() if close else len(text)
        elif tag not in VOID and not attributes.endswith("/"):
            open_at.setdefault(tag, []).append(len(stack))
            if tag in BLOCKS:
                blocks_at.append(len(stack))
            stack.append(node)


def blocks(node: Node, skip) -> list[str]:
    """Texts of the blocks under a node, in order, without the nodes that ``skip`` names."""
    out, open_ = [], []

    def close():
        line = " ".join("".join(open_).split())  # the white space of str.isspace, as \s has it
        if line:
            out.append(line)
        open_.clear()

    stack = [iter([node])]
    ends = [False]
    while stack:
        c = next(stack[-1], None)
        if c is None:
            stack.pop()
            if ends.pop():
                close()
        elif isinstance(c, str):
            open_.append(c)
        elif c.tag == "br":
            open_.append(" ")
        elif not skip(c):
            block = c.tag in BLOCKS
            if block:
                close()
            stack.append(iter(c.children))
            ends.append(block)
        elif c.tag in BLOCKS:
            close()
    close()
    return out


@dataclass
class Slot:
    """A node of the compressed tree: one element, or a run of like siblings."""

    label: tuple
    nodes: list
    children: list
    number: int = -1

    def text(self) -> str:
        return "\n".join(x for n in self.nodes for x in blocks(n, lambda c: False))


def compress(node: Node) -> Slot:
    """The tree of block elements outside furniture, numbered from the root on;
    like neighbours that are no containers are one slot."""
    root = Slot(node.label, [node], [], 0)
    count, todo = 1, [root]
    while todo:
        slot = todo.pop()
        n = slot.nodes[0]
        if n.tag not in CONTAINERS and n.tag != "#page":
            continue
        for c in n.children:
            if not isinstance(c, Node) or c.tag not in BLOCKS or c.is_furniture():
                continue
            last_ = slot.children[-1] if slot.children else None
            if last_ is not None and last_.label == c.label and c.tag not in CONTAINERS:
                last_.nodes.append(c)
            else:
                slot.children.append(Slot(c.label, [c], [], count))
                count += 1
        todo += reversed(slot.children)
    return root


def slots(root: Slot) -> list[Slot]:
    """All slots of a tree, each before its children."""
    out, todo = [], [root]
    while todo:
        out.append(todo.pop())
        todo += reversed(out[-1].children)
    return out


def shape(root: Slot) -> tuple[int, int]:
    """A hash of the tree's labels and nesting, and its number of slots."""
    found = slots(root)
    return xxhash.xxh3_64_intdigest("|".join(
        f"{s.label[0]}.{'.'.join(sorted(s.label[1]))}{len(s.children)}" for s in found).encode("utf-8", "surrogatepass")) >> 1, len(found)


def align(a: Slot, b: Slot) -> list[tuple[Slot, Slot]]:
    """Simple tree matching: the largest set of equal-labelled pairs that keeps
    order and ancestry; children are matched in sequence, by dynamic programming."""
    known: dict = {}  # (number, number) -> size of the best match of two equal-labelled slots

    def score(x: Slot, y: Slot) -> int:
        return known[x.number, y.number] if x.label == y.label else 0

    def grid(x: Slot, y: Slot) -> list[list[int]]:
        rows = [[0] * (len(y.children) + 1)]
        for p in x.children:
            row = [0]
            for j, q in enumerate(y.children):
                row.append(max(row[j], rows[-1][j + 1], rows[-1][j] + score(p, q)))
            rows.append(row)
        return rows

    todo = [(a, b, False)] if a.label == b.label else []
    while todo:  # children before their parents
        x, y, ready = todo.pop()
        if ready:
            known[x.number, y.number] = 1 + (grid(x, y)[-1][-1] if x.children and y.children else 0)
        elif (x.number, y.number) not in known:
            todo.append((x, y, True))
            todo += [(p, q, False) for p in x.children for q in y.children if p.label == q.label]

    out, pairs = [], [(a, b)] if a.label == b.label else []
    while pairs:
        x, y = pairs.pop()
        out.append((x, y))
        g = grid(x, y) if x.children and y.children else None
        i, j = len(x.children), len(y.children)
        while g and i and j:
            s = score(x.children[i - 1], y.children[j - 1])
            if s and g[i][j] == g[i - 1][j - 1] + s:
                pairs.append((x.children[i - 1], y.children[j - 1]))
                i, j = i - 1, j - 1
            elif g[i][j] == g[i - 1][j]:
                i -= 1
            else:
                j -= 1
    return out
