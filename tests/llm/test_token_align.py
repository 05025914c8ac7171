"""Cross-tokenizer alignment against plain loops over every byte."""

import collections
import hashlib

import numpy as np
import pytest

from salespanel.llm import token_align as T

KIND = "doc_id long, text string, row string, a int, n_best string, salt string"
TEXTS = [None, "", " ", "hello world", "hello world", "Grüße aus Köln, ça va?", "日本語のテキスト 😀 emoji", "x▁y piece mark",
         "<|endoftext|> and </s> are plain", "tabs\tand\nlines  double", "a" * 900, "The quick brown fox. " * 4000, "naïvé é",
         "\x00nul", "  lead and trail  "]


def brute(texts):
    """Groups, links and corpus counts from byte positions alone."""
    pair = T.pair_of(*T.tokenizer_files())
    found = []
    for text in texts:
        want = (" " + (text or "")).encode()
        sides = []
        if text:
            sides = [pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)]
        if not text or any(b"".join(of[i] for i in ids) != want for of, ids in zip(pair.bytes_of, sides)):
            found.append(([], [], [], []))
            continue
        at = []
        for of, ids in zip(pair.bytes_of, sides):
            pos, spans = 0, []
            for i in ids:
                spans.append((pos, pos + len(of[i]), i))
                pos += len(of[i])
            at.append(spans)
        cuts = sorted({e for _, e, _ in at[0]} & {e for _, e, _ in at[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append([[i for s, e, i in spans if low <= s and e <= cut] for spans in at] if len(want) < 2000 else None)
            low = cut
        owner = np.repeat(np.arange(len(at[1])), [e - s for s, e, _ in at[1]])  # the B token of each byte
        links = [(i, at[1][j][2]) for s, e, i in at[0] for j in sorted(set(owner[s:e].tolist()))]
        found.append((sides[0], sides[1], groups, links))
    counts = collections.Counter(p for f in found for p in set(f[3]))
    most = collections.Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for a, b, groups, links in found:
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups) if groups and groups[0] else None
        out.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links),
                    "" if not groups else hashlib.sha256(text.encode()).hexdigest() if text is not None else None))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 9 else None, t, "clash", 5, "clash", "clash") for i, t in enumerate(TEXTS)], KIND)


@pytest.mark.parametrize("limit,step", [(T.BROADCAST_BYTES, T.STEP_BYTES), (0, 64)])
def test_counts_match_brute_force(docs, limit, step, monkeypatch):
    monkeypatch.setattr(T, "STEP_BYTES", step)
    got = T.alignment_counts(docs, limit=limit)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = {r.doc_id if r.doc_id is not None else 9: tuple(r)[1:] for r in got.collect()}
    want = brute(TEXTS)
    assert len(rows) == len(want)
    for i, w in enumerate(want):
        assert rows[i][:6] == w[:6], TEXTS[i]
        if w[6] is not None:
            assert rows[i][6] == w[6]
    assert rows[0] == rows[1] == rows[7] == (0, 0, 0, 0, 0, 0, "")
    assert rows[6][0] > 0 and rows[11][0] > 10_000


def test_groups_join_to_the_text(docs):
    pair = T.pair_of(*T.tokenizer_files())
    for r in T.aligned(docs).collect():
        text = TEXTS[9 if r.doc_id is None else r.doc_id]
        if not r.a_ids:
            continue
        sides = []
        for ids, groups, of in ((r.a_ids, r.a_group, pair.bytes_of[0]), (r.b_ids, r.b_group, pair.bytes_of[1])):
            got = collections.defaultdict(bytes)
            for i, g in zip(ids, groups):
                got[g] += of[i]
            sides.append(got)
        assert sides[0] == sides[1] and list(sides[0]) == list(range(len(sides[0])))
        assert b"".join(sides[0].values()).decode() == " " + text


def test_coalesce_breaks_where_a_start_reaches_the_furthest_end():
    start, end = np.array([0, 2, 9, 0, 1, 6, 9]), np.array([2, 9, 12, 1, 6, 9, 12])
    assert T.coalesce(start, end, np.array([0, 0, 0, 1, 1, 1, 1])).tolist() == [0, 0, 1, 0, 0, 0, 1]
    assert T.coalesce(np.zeros(0, int), np.zeros(0, int), np.zeros(0, int)).tolist() == []


def test_empty_table(spark):
    assert T.alignment_counts(spark.createDataFrame([], KIND)).count() == 0


def test_summary_is_that_of_the_whole_alignment():
    """Put together from units, however they are remembered, or from all tokens at once."""
    pair = T.pair_of(*T.tokenizer_files())
    texts = [t or "" for t in TEXTS] + ["more of the same words, more or less", "same words"]
    for known in (T.KNOWN_UNITS, 0):
        T.KNOWN_UNITS, before = known, T.KNOWN_UNITS
        try:
            s = T.summary(texts, pair)
        finally:
            T.KNOWN_UNITS = before
        m = T.align(texts, pair)
        assert s.n_a.tolist() == m.per_doc(m.docs[0]).tolist() and s.n_b.tolist() == m.per_doc(m.docs[1]).tolist()
        assert s.n_groups.tolist() == m.n_groups().tolist() and s.shown == m.group_texts(pair)
        i, j = m.links
        assert s.n_links.tolist() == m.per_doc(m.docs[0][i]).tolist()
        want = collections.Counter(zip(m.docs[0][i].tolist(), m.ids[0][i].tolist(), m.ids[1][j].tolist()))
        assert dict(zip(zip(*[x.tolist() for x in s.pairs[:3]]), s.pairs[3].tolist())) == want
