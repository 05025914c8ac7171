"""Merkle manifest against a recursive version, log positions against a real postorder walk."""

import hashlib
import random
import zlib

import duckdb
import pytest

from salespanel.llm import merkle as M

KIND = "doc_id long, text string, lang string, source string, n_chars long, tree string, position int, index string, _read int"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, text, lang, source, n_chars):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return _h(*map(field, (doc_id, source, lang, n_chars, text)))


def _tree(nodes):
    """(root, for each leaf the runs up to it)"""
    paths = [[] for _ in nodes]
    level, of = list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for k in range(len(nodes)):
            first = of[k] // 8 * 8
            paths[k].append((level[first:of[k]], level[of[k] + 1:first + 8]))
            of[k] //= 8
        level = [_h(*level[k:k + 8]) for k in range(0, len(level), 8)]
    return level[0], paths


def expected(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, _leaf(*r[:5]), r))
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    made = {lang: _tree([t[2] for t in sorted(trees[lang], key=lambda t: t[:3])]) for lang in order}
    root, tops = _tree([made[lang][0] for lang in order])
    out = []
    for lang, top in zip(order, tops):
        for (*_, leaf, r), path in zip(sorted(trees[lang], key=lambda t: t[:3]), made[lang][1]):
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = _leaf(r[0], text, *r[2:5])
            for left, right in path + top:
                node = _h(*left, node, *right)
            proof = _h(*[d for left, right in path + top for d in left + right])
            out.append((r[0], leaf, made[lang][0], root, proof, node, node == root))
    return out


def made_rows(seed, sizes):
    r = random.Random(seed)
    out = []
    for lang, n in sizes.items():
        out += [(r.randint(-50, 10 ** 18) if r.random() > 0.05 else None, r.choice([None, "", "Ünï Text", "plain", "A" * 300]), lang,
                 r.choice([None, "s", "Z:3"]), r.choice([None, 0, 7]), "clash", 3, "clash", 4) for _ in range(n)]
    out += out[:5]  # repeated rows
    r.shuffle(out)
    return out


@pytest.mark.parametrize("sizes", [{"en": 700, "de": 65, None: 9, "": 1, "=": 2, "-": 1, "é": 8}, {"en": 1}, {"en": 4500, "de": 4096, "fr": 4097, None: 8}, {str(k): 2 for k in range(70)}])
def test_proofs_match_recursive_version(spark, sizes):
    rows = made_rows(len(sizes), sizes)
    docs = spark.createDataFrame(rows, KIND).repartition(6)
    got = M.checked(M.manifest(docs, M.leaf_hash(M.F.when(M.tampered(M.F.col("doc_id")), M.F.translate("text", M.UPPER, M.LOWER)).otherwise(
        M.F.col("text"))).alias("claimed")))
    got = [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.folded_root == r.root) for r in got.collect()]
    want = expected(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert len(rows) < 20 or {True, False} == {x[6] for x in got}


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 520, 4097])
def test_positions_are_the_postorder(n):
    walked = []

    def walk(h, j):
        if h:
            for c in range(8 * j, min(8 * j + 8, M.width(n, h - 1))):
                walk(h - 1, c)
        walked.append((h, j))

    walk(M.height_of(n), 0)
    assert [int(M.position(n, h, j)) for h, j in walked] == list(range(len(walked)))


def test_log_is_whole_and_in_place(spark):
    docs = spark.createDataFrame(made_rows(1, {"en": 100, "de": 3}), KIND)
    log = M.manifest(docs).log.collect()
    for tree in ("=en", "=de"):
        own = sorted((r["position"], r["height"], r["index"]) for r in log if r.tree == tree)
        assert [p for p, *_ in own] == list(range(len(own)))
        n = sum(h == 0 for _, h, _ in own)
        assert [int(M.position(n, h, j)) for _, h, j in own] == list(range(len(own)))


def test_query_matches_sql(spark, tmp_path):
    rows = made_rows(3, {"en": 300, "de": 70, None: 9})
    spark.createDataFrame(rows, KIND).write.parquet(f"{tmp_path}/documents.parquet")
    got = M.query(spark, str(tmp_path))
    columns = got.columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = con.execute(M.ORACLE)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(columns)
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], KIND).write.parquet(f"{tmp_path}/documents.parquet")
    assert M.query(spark, str(tmp_path)).collect() == []
