"""HTML extraction: matching against brute force, odd pages, hosts of several templates."""

import functools
import itertools
import random
import re
import sys

import pytest

from salespanel.llm import page_tree, pages
from salespanel.llm.page_tree import Slot, align, blocks, compress, parse, shape, slots

KIND = "page_id long, url string, html string"


def texts(spark, rows):
    return {r.page_id: r._text for r in pages.with_main_text(spark.createDataFrame(rows, KIND)).collect()}


def random_tree(r, depth):
    return (r.choice("ab"), tuple(random_tree(r, depth - 1) for _ in range(r.randint(0, 3))) if depth else ())


def as_slots(tree):
    count = itertools.count()

    def build(t):
        return Slot((t[0], frozenset()), [], [], next(count)), t[1]

    root, below = build(tree)
    todo = [(root, below)]
    while todo:
        at, below = todo.pop()
        for t in below:
            c, rest = build(t)
            at.children.append(c)
            todo.append((c, rest))
    return root


@functools.cache
def best(a, b):
    """The size of the largest match, by trying every ordered choice of child pairs."""
    if a[0] != b[0]:
        return 0
    most = 0
    for n in range(min(len(a[1]), len(b[1])) + 1):
        for left in itertools.combinations(a[1], n):
            for right in itertools.combinations(b[1], n):
                most = max(most, sum(best(x, y) for x, y in zip(left, right)))
    return 1 + most


def test_matching_is_the_largest_one():
    r = random.Random(4)
    for _ in range(300):
        a, b = random_tree(r, 3), random_tree(r, 3)
        got = align(as_slots(a), as_slots(b))
        assert len(got) == best(a, b)
        assert all(x.label == y.label for x, y in got)
        assert len({x.number for x, _ in got}) == len(got) == len({y.number for _, y in got})


def test_nesting_of_any_depth(spark):
    deep = "<div>" * 100_000 + "<p>at the bottom</p>" + "</div>" * 100_000
    tree = compress(parse(deep))
    assert len(slots(tree)) == 100_002 and len(align(tree, compress(parse(deep)))) == 100_002
    assert shape(tree) == shape(compress(parse(deep)))
    ad = "<div class='ad'>" * 50_000 + "<article><p>held</p></article>" + "</div>" * 50_000
    got = texts(spark, [(1, "http://deep.x/1", deep), (2, "http://deep.x/2", deep), (3, "http://deep.x/3", ad), (4, "http://deep.x/4", "<p>" * 100_000 + "x"),
                        (5, "http://deep.x/5", "<article><p>whole " + "long " * 200_000 + "text</p></article>")])
    assert got[1] == got[2] == "at the bottom" and got[3] == "held" and got[4] == "x"
    assert got[5] == ("whole " + "long " * 200_000 + "text")


def test_all_articles_in_order_and_text_blocks_by_any_class(spark):
    got = texts(spark, [
        (1, "http://a.x/1", "<body><nav>menu</nav><article>one story here</article><article>second story that is longer</article></body>"),
        (2, "http://a.x/2", "<article><p class='related'>part of the story</p><div class='ad'>buy</div><p>b</p><div class='comments'>c</div></article>"),
        (3, "http://a.x/3", "<article class='comment'>mine</article><article>the story</article>")])
    assert got == {1: "one story here\nsecond story that is longer", 2: "part of the story\nb", 3: "the story"}


@pytest.mark.parametrize("others", [0, 400])
def test_hosts_with_empty_pages_and_other_layouts_keep_their_wrapper(spark, others):
    r = random.Random(others)
    words = lambda n: " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(n))
    page = lambda k: (f"<body><div id=top><p>Site name</p><p>since 1999</p></div><div id=mid><p>{words(60)} {k}</p><p>{words(40)}</p></div>"  # noqa: E731
                      "<div id=low><p>All rights</p></div></body>")
    rows = [(k, f"http://h.x/{k}", page(k)) for k in range(30)]
    rows += [(1000 + k, f"http://h.x/e{k}", [None, "", "<body><h1>404</h1></body>"][k % 3]) for k in range(others)]
    got = texts(spark, rows)
    assert len(got) == 30 + others
    for k in range(30):
        assert "Site name" not in got[k] and "All rights" not in got[k] and f" {k}\n" in got[k]
    assert all(got[1000 + k] == ("404" if k % 3 == 2 else "") for k in range(others))


def test_two_layouts_of_a_host(spark):
    one = lambda k: f"<body><div id=a><p>head</p></div><div id=b><p>story {k} {'x' * k}</p></div></body>"
    two = lambda k: f"<body><table><tr><td><p>fixed</p></td></tr></table><section id=s><p>tale {k} {'y' * k}</p></section></body>"
    got = texts(spark, [(k, "http://two.x/", (one if k % 2 else two)(k)) for k in range(1, 41)])
    for k in range(1, 41):
        assert got[k] == (f"story {k} {'x' * k}" if k % 2 else f"tale {k} {'y' * k}")


def test_plain_parts():
    assert blocks(parse("<p>a&amp;b<br>c <b>d</b></p><ul><li>x<li>y</ul>z"), lambda n: False) == ["a&b c d", "x", "y", "z"]
    assert pages.main_text(None) == pages.main_text("<!-- only a note") == ""


def test_repeated_attributes_are_read_once():
    page_tree._read_again.cache_clear()
    tag = '<div class="post wideColumn" id=x role="Main">'
    root = parse((tag + "text</div>") * 50 + '<p hidden>gone</p><p class="' + "long " * 100 + '">kept</p>')
    info = page_tree._read_again.cache_info()
    assert (info.misses, info.hits) == (2, 49)  # long attributes are not remembered
    assert root.children[0].words == {"post", "wide", "column", "x"} and root.children[49].role == "main"
    assert root.children[0].children is not root.children[1].children
    assert root.children[50].hidden and root.children[51].words == {"long"}


def test_any_white_space_becomes_one_space():
    space = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if re.match(r"\s", c))
    assert blocks(parse("<p>" + space + "a" + space + "b" + space + "</p>"), lambda n: False) == ["a b"]
    assert not [c for c in space if blocks(parse(f"<p>a{c}b</p>"), lambda n: False) != ["a b"]]
