"""Operators without SQL against plain loops: explicit pairs, plain convolution,
a python sketch, a recursive split."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from salespanel.llm import fingerprint, quality, sharding, toxicity


def test_machine_equals_explicit_pairs():
    r = random.Random(1)
    texts = [" ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(1, 40))) + r.choice(["!", ".", "\n%"]) for _ in range(60)]
    m = quality.fit(texts, np.array([i % 2 for i in range(60)], float))
    assert np.abs(m["v"]).max() > 0.06  # the pairs have learned something
    for text in [*texts[:20], None, "", "one", "many words " * 50]:
        s, at, value = quality.features(text)
        idx, val, _ = quality._rows(np.array([s]), m["edges"], [at], [value])
        want = m["w0"] + sum(m["w"][i] * x for i, x in zip(idx, val))
        for a in range(len(idx)):
            for b in range(a + 1, len(idx)):
                want += float(m["v"][idx[a]] @ m["v"][idx[b]]) * val[a] * val[b]
        assert np.isclose(quality.predict(m, [text])[0], 1 / (1 + np.exp(-want)), rtol=1e-9)


@pytest.mark.parametrize("block", [1 << 15, 8])
def test_network_equals_a_plain_convolution(block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    r = random.Random(2)
    text = lambda n: " ".join(r.choice("abcdefgh") * r.randint(1, 7) for _ in range(n))
    texts = [text(r.randint(1, 30)) + (" scoundrel!" if i % 2 else "") for i in range(80)]
    b = toxicity._Buckets()
    compact = toxicity.fit([toxicity.tokens(t, b) for t in texts], np.array([i % 2 for i in range(80)], float))
    m = toxicity.ready(toxicity.read_model(toxicity.stored_model(compact)))
    table = m["e"].astype(np.float64)
    for t in [*texts[:10], None, "", text(100)]:
        ids = toxicity.tokens(t, b)
        x = table[ids].sum(1)
        pooled = []
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0  # what is below nought counts as nought
                for at in range(len(ids) - max(toxicity.WIDTHS) + 1):
                    best = max(best, m["b"][k][f] + sum(x[at + j] @ m["f"][k][j][:, f].astype(np.float64) for j in range(width)))
                pooled.append(best)
        assert np.isclose(toxicity.margins(m, [ids])[0], np.dot(pooled, m["u"]) + m["c"], rtol=1e-3, atol=1e-4)


def _sketch(text, k=fingerprint.K):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", (text or "").lower()) if w]
    size = fingerprint.SHINGLE
    runs = [words[i:i + size] for i in range(len(words) - size + 1)] if len(words) >= size else [words] if words else []
    found = set()
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        found.add(h >> (64 - fingerprint.HASH_BITS))
    return sorted(found)[:k]


def _likeness(a, b, k=fingerprint.K):
    union = sorted(set(a) | set(b))[:k]
    return 1.0 if not union else len(set(union) & set(a) & set(b)) / len(union)


def test_fingerprints_equal_a_plain_sketch(spark, tmp_path):
    r = random.Random(3)
    text = lambda n: " ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(n))
    base = text(400)
    rows = [(i * 7 % 101, t) for i, t in enumerate(
        [None, "", "  \t", "one two", "One TWO", base, base, base + " more", text(3000), "é ü ñ a b c", *[text(r.randint(1, 80)) for _ in range(40)]])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in fingerprint.query(spark, str(tmp_path)).collect()}
    rows.sort()
    shown = lambda s: "".join(f"{h:012x}" for h in s)
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        g = got[i]
        assert g.n_chars == len(t) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.fingerprint == shown(_sketch(t)) and g.edited_fingerprint == shown(_sketch(edited))
        assert g.near_edited == pytest.approx(_likeness(_sketch(t), _sketch(edited))) and g.near_next == pytest.approx(_likeness(_sketch(t), _sketch(after)))


@pytest.mark.parametrize("limit", [50, 600, 5000, 10 ** 9])
def test_directory_equals_a_recursive_split(spark, limit):
    r = random.Random(4)
    rows = [(i, "x" * r.randint(0, 300)) for i in range(200)] + [(500, "y" * 40)] * 30 + [(501, None), (502, "z" * 4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashed = docs.selectExpr("doc_id", "xxhash64(doc_id, text) AS h", "coalesce(octet_length(text), 0) AS n").collect()
    want = {}

    def split(own, prefix):
        if sum(x.n for x in own) <= limit or len({x.h for x in own}) == 1:
            for x in own:
                want[x.doc_id] = (prefix, sum(y.n for y in own))
            return
        for bit in "01":
            part = [x for x in own if f"{x.h & (1 << 64) - 1:064b}"[len(prefix)] == bit]
            if part:
                split(part, prefix + bit)

    split(hashed, "")
    got = sharding.sharded(docs, limit).collect()
    assert len(got) == len(rows)
    sums = {}
    for x in got:
        prefix, whole = want[x.doc_id]
        name, _, part = x.shard.partition(".")
        assert name == "s" + prefix and x.shard_depth == len(prefix)
        assert bool(part) == (whole > limit and x.doc_id == 500)
        sums[x.shard] = sums.get(x.shard, 0) + len(x.text or "")
    assert all(x.shard_bytes == sums[x.shard] for x in got)
    assert all(n <= limit for s, n in sums.items() if sum(x.shard == s for x in got) > 1)
