"""The operators against brute force, on small tables with odd cases:
nulls, empty and long texts, repeated rows, clashing extra columns."""

import collections
import itertools
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from salespanel.llm import decontaminate, fingerprint, lm_score, mixing, ngram_join, pages, quality, sharding, substring, toxicity
from salespanel.llm.lm_trie import EliasFano, Trie
from salespanel.llm.page_tree import align, compress, parse

KIND = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, _score double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = ["w%d" % i for i in range(400)] + ["Ünï", "the", "of"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    base, passage = text(80), text(50)
    out = [None, "", "  \n\t ", "one two", "one two", "One TWO", base, base, base.replace("w1", "w2", 1), base + " tail of it",
           text(30) + " " + passage + " " + text(20), passage, text(3000) + " " + passage, "x " * 90, text(12)]
    out += [text(r.randint(1, 60)) for _ in range(20)]
    made = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or ""), "clash", "clash", 0.5) for i, t in enumerate(out)]
    return made + [made[6], (None, "an id is missing here", None, None, 0, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def _words(t):
    return (t or "").encode().split()


def _set(t):
    w = (t or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i:i + 5]) for i in range(len(w) - 4)))


@pytest.mark.parametrize("tile", [512, 3])
def test_join_finds_all_components(docs, rows, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "PAIR_CLASSES", 256 if tile > 3 else 2)
    sets = {r[0]: _set(r[1]) for r in rows if r[0] is not None}
    up = {i: i for i in sets}
    for a, b in itertools.product(sets, sets):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            low, high = sorted((up[a], up[b]))
            up = {k: low if v == high else v for k, v in up.items()}
    got = ngram_join.with_component(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {
        i: (len(s), up[i]) for i, s in sets.items()}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({up[i] for i in sets})


def test_one_of_each_tells_rows_of_an_id_apart(spark):
    word = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    made = [(1, word("a", 60)), (2, word("a", 60) + " tail"), (2, word("b", 60)), (2, word("b", 60)), (3, word("c", 60)), (3, word("d", 60)),
            (4, word("e", 60)), (4, word("e", 60) + " tail"), (5, None), (5, ""), (5, word("d", 60) + " tail")]
    got = ngram_join.one_of_each(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, (r.text or "")[:1]) for r in got) == [(1, "a"), (2, "b"), (3, "c"), (3, "d"), (4, "e"), (5, "")]


def test_substring_matches_brute_force(docs, rows):
    counts = collections.Counter(tuple(w[i:i + 35]) for r in rows for w in [_words(r[1])] for i in range(len(w) - 34))
    want = []
    for r in rows:
        w, gone = _words(r[1]), set()
        for i in range(len(w) - 34):
            if counts[tuple(w[i:i + 35])] > 1:
                gone.update(range(i, i + 35))
        want.append((r[0] if r[0] is not None else -1, " ".join(x.decode() for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    got = [(r.doc_id if r.doc_id is not None else -1, r._kept, r._n_words, r._n_removed) for r in substring.with_kept(docs).collect()]
    assert sorted(got) == sorted(want)


def test_decontaminate(spark, docs, rows):
    long = rows[6][1].split()
    bench = spark.createDataFrame([(1, " ".join(long[5:30])), (2, "ONE-two"), (3, None), (4, "not there at all"), (None, "")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    assert got[6].n_hit == 25 and got[3].n_hit == 2 and got[5].contaminated and not got[0].contaminated
    assert got[14].n_items == 0 and got[0].n_words == 0
    assert 6 not in {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()}
    cut = {r.doc_id: r for r in decontaminate.decontaminated(docs, bench, remove="spans").collect()}
    assert cut[6].text == " ".join(long[:5] + long[30:]) and cut[6].n_chars == len(cut[6].text) and cut[0].text is None


def test_mixing_targets(docs, rows):
    got = mixing.mix_rates(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(_words(r[1]))
    target = {r.source: r._mix_target for r in got}
    assert all(target[s] <= 3 * sizes[s] + 1e-6 for s in sizes)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert all(r._mix_copies <= 3 for r in got)
    assert mixing.mixed(docs).count() == sum(r._mix_copies for r in got)


def test_sharding_fits(docs, rows):
    got = sharding.sharded(docs, 600).collect()
    assert len(got) == len(rows)
    held = collections.defaultdict(list)
    for r in got:
        held[r.shard].append(len((r.text or "").encode()))
    assert all(sum(x) <= 600 or len(x) == 1 for x in held.values()) and len(held) > 5
    assert all(sum(held[r.shard]) == r.shard_bytes for r in got)


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprint.with_next(fingerprint.fingerprints(docs), ["text", "sketch"]).withColumn(
        "near", fingerprint.resemblance(fingerprint.F.col("sketch"), fingerprint.F.col("next_sketch"))).collect()}
    assert got[6].sketch == got[7].sketch and got[6].near == 1.0 and got[0].near == 1.0 and got[2].near == 0.0
    assert got[3].next_text == "one two" and got[None].next_text == "" and len(got[12].sketch) == fingerprint.K


def test_language_model(docs, rows):
    known = docs.where("doc_id % 3 <> 0")
    counts = collections.Counter(x for r in rows if r[0] is not None and r[0] % 3 for x in [w.lower() for w in _words(r[1])] + [b"\n"])
    total, kinds = sum(counts.values()), len(counts)
    for r in lm_score.scored(docs, known).collect():
        if r.doc_id is not None:
            w = [x.lower() for x in _words(rows[r.doc_id][1])] + [b"\n"]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in counts for x in w), total)
            assert r.base_score == pytest.approx(sum(np.log10((counts[x] + 1) / (total + kinds + 1)) for x in w))
            assert r.score < 0


@pytest.mark.parametrize("dictionary, hot", [(500_000, 1_000_000), (10, 3), (0, 3)])
def test_language_model_counts_every_word_pair_and_triple(docs, rows, dictionary, hot, monkeypatch):
    monkeypatch.setattr(lm_score, "DICTIONARY", dictionary)
    monkeypatch.setattr(lm_score, "HOT", hot)
    tokens = lambda t: [x.lower() for x in _words(t)] + [b"\n"]
    one, two, three = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        if r[0] is not None and r[0] % 3:
            w = [None, *tokens(r[1])]
            one.update(w[1:])
            two.update(zip(w, w[1:], strict=False))
            three.update(zip(w, w[1:], w[2:], strict=False))
    n1, t1, n2, t2 = (collections.Counter() for _ in range(4))
    for (u, _), c in two.items():
        n1[u] += c
        t1[u] += 1
    for (u, v, _), c in three.items():
        n2[u, v] += c
        t2[u, v] += 1
    total, once, twice = sum(one.values()), sum(c == 1 for c in one.values()), sum(c == 2 for c in one.values())
    off = once / (once + 2 * twice) if once and twice else 0.5

    def p(context, w):
        if not context:
            return (one[w] - off) / total if w in one else off * len(one) / total
        n, t, c = (n1[context[0]], t1[context[0]], two[(*context, w)]) if len(context) == 1 else (n2[context], t2[context], three[(*context, w)])
        return (max(c - 0.75, 0) + 0.75 * t * p(context[1:], w)) / n if n else p(context[1:], w)

    got = lm_score.scored(docs, docs.where("doc_id % 3 <> 0")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            w = [None, *tokens(rows[r.doc_id][1])]
            assert r.score == pytest.approx(sum(np.log10(p(tuple(w[max(0, i - 2):i]), w[i])) for i in range(1, len(w))), abs=1e-5)


def test_language_model_sends_no_row_a_word(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{j // 2}" for j in range(60))) for i in range(200)]  # 6,000 words, twice each, outside of the dictionary
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes, written = {}, lm_score.written

    def counted(spark, df, name):
        out = written(spark, df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(lm_score, "written", counted)
    monkeypatch.setattr(lm_score, "DICTIONARY", 1)
    got = lm_score.scored(docs, docs).collect()
    assert sizes.pop("lm-words") == 6001
    assert sizes and max(sizes.values()) < 1000, sizes
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(61, 61, 200 * 61)}
    base = 60 * np.log10(3 / (200 * 61 + 6002)) + np.log10(201 / (200 * 61 + 6002))
    assert all(r.base_score == pytest.approx(base) for r in got)


def test_language_model_scores_alike_however_rows_are_dealt(docs, rows, monkeypatch):
    monkeypatch.setattr(lm_score, "DICTIONARY", 10)
    monkeypatch.setattr(lm_score, "HOT", 3)
    training = docs.where("doc_id % 3 <> 0")
    one, many = (sorted(lm_score.scored(docs.repartition(n), training.repartition(n)).collect(), key=str) for n in (1, 9))
    assert one == many and len(one) == len(rows)


def test_numbers_travel_in_as_many_bytes_as_the_largest_needs():
    for top in (1, 1 << 7, 1 << 9, 1 << 30, 1 << 62):
        x = np.random.default_rng(3).integers(0, top, 500)
        assert lm_score._unpacked(lm_score._packed(x)).tolist() == x.tolist()
    assert lm_score._unpacked(lm_score._packed(np.zeros(0, np.int64))).tolist() == []
    h = np.sort(np.random.default_rng(5).integers(0, 1 << 64, 500, np.uint64))
    assert np.cumsum(lm_score._unpacked(lm_score._packed(np.diff(h, prepend=np.uint64(0))), np.uint64), dtype=np.uint64).tolist() == h.tolist()


def test_most_frequent_words_are_cut_exactly(spark):
    counts = spark.createDataFrame([(i - 30, c) for i, c in enumerate([70_000 + i for i in range(40)] + [5] * 20)], "h long, c long")
    for most in (0, 7, 40, 60, 100):  # all of the first 40 lie above 65,536
        assert lm_score.most_frequent(counts, "c", most)[1].tolist() == sorted([70_000 + i for i in range(40)] + [5] * 20)[::-1][:most]
    spread = spark.createDataFrame([(int(x), 90_000) for x in np.random.default_rng(2).integers(-2 ** 62, 2 ** 62, 50)], "h long, c long")
    assert len(lm_score.most_frequent(spread, "c", 20)[0]) == 20


def test_language_model_sends_no_count_of_words_met_once():
    keys = np.array([7, 3], np.int64), np.array([0, 5], np.int64)
    assert lm_score._looked_up(*keys, np.array([3, 7, 9]), lm_score.ONCE).tolist() == [5, 0, 1]
    assert lm_score._looked_up(*(np.zeros(0, np.int64),) * 2, np.array([9]), lm_score.ONCE).tolist() == [1]


def test_keys_and_runs_of_a_part_travel_in_few_bytes():
    k = np.cumsum(np.random.default_rng(2).integers(1, 4, 3000)) + (5 << 33)
    assert lm_score._read_keys(lm_score._keys(k)).tolist() == k.tolist() and len(lm_score._keys(k)) < len(k)
    runs = np.array([1] * 3000 + [1 << 20])
    assert lm_score._inflated(lm_score._deflated(runs)).tolist() == runs.tolist() and len(lm_score._deflated(runs)) < 100


def test_elias_fano_seeks_what_is_there():
    x = np.sort(np.random.default_rng(4).integers(0, 4000, 700))
    at, same = EliasFano(x).seek(np.arange(4200))
    assert same.tolist() == np.isin(np.arange(4200), x).tolist()
    assert at[same].tolist() == np.searchsorted(x, np.flatnonzero(same)).tolist()


def test_elias_fano_and_trie():
    r = np.random.default_rng(1)
    x = np.sort(r.integers(0, 50_000, 3000))
    e = EliasFano(x).map()
    assert (e.get(np.arange(3000)) == x).all()
    q = r.integers(0, x[-1] + 1, 2000)
    assert (e.successor(q) == np.searchsorted(x, q)).all()
    base, unigram = 21, np.full(20, 0.05)
    classes = r.integers(0, 20, 5000)
    pairs = np.unique(classes[:-1] * base + classes[1:], return_counts=True)
    totals = np.bincount(classes[:-1], minlength=base).astype(float)
    t = Trie(unigram, pairs, totals, np.unique(classes[:-2] * base * base + classes[1:-1] * base + classes[2:], return_counts=True))
    for context in ([3], [3, 7]):  # every context's probabilities come to one, but for quantising
        each = [10 ** t.score(np.array([*context, w]), np.arange(len(context) + 1) == 0)[-1] for w in range(20)]
        assert sum(each) == pytest.approx(1, abs=0.05)


def test_classifiers_learn():
    r = random.Random(5)
    good = [" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(40)) for _ in range(120)]
    bad = [t.upper().replace(" ", "!! ") for t in good[:60]]
    m = quality.fit(good[:80] + bad[:40], np.array([1.0] * 80 + [0.0] * 40))
    s = quality.predict(m, good[80:] + bad[40:] + [None, ""])
    assert s[:40].min() > s[40:60].max() and ((0 <= s) & (s <= 1)).all()
    rude = [t + " scoundrel " + t for t in good]
    b = toxicity._Buckets()
    model = toxicity.fit([toxicity.tokens(t, b) for t in good[:80] + rude[:80]], np.array([0.0] * 80 + [1.0] * 80))
    s = toxicity.predict(model, good[80:] + rude[80:] + [None, "scoundrel"])
    assert s[:40].max() < s[40:80].min() and len(s) == 82


def test_toxicity_holds_the_rows_of_one_text_at_a_time():
    b = toxicity._Buckets()
    model = toxicity.fit([toxicity.tokens(t, b) for t in ["good day", "bad day"] * 8], np.array([0.0, 1.0] * 8))
    texts = ["good bad " * 25_000] * 150  # 600 kB of rows each
    tracemalloc.start()
    try:
        s = toxicity.predict(model, texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(s) == 150 and len(set(s.tolist())) == 1 and peak < 60e6


def test_toxicity_is_fitted_on_four_of_five_of_a_class_batch_by_batch():
    rows = [{"doc_id": i, "text": ["a scoundrel", "a day", None][i % 3], "label": int(i % 3 == 0)} for i in range(60)]
    fit = lambda size, rows: list(toxicity._fitted(iter([pa.RecordBatch.from_pylist(rows[i:i + size]) for i in range(0, len(rows), size)])))
    one, other = (fit(size, rows)[0].to_pylist()[0] for size in (60, 7))
    left = [i for y in (0, 1) for i in [r["doc_id"] for r in rows if r["label"] == y][4::5]]
    assert one["fitted"] == other["fitted"] == sorted(set(range(60)) - set(left)) and one["model"] == other["model"]
    assert not fit(60, [r for r in rows if r["label"]])


def test_toxicity_thresholds_keep_the_mix_of_all_labels(spark):
    r = random.Random(8)
    plain = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20))
    made = [(plain() + " scoundrel", 1) for _ in range(60)] + [(plain(), 0) for _ in range(200)]
    made += [("a rogue spoke", int(i % 9 == 0)) for i in range(540)] + [("a rogue spoke " * 1000, 0) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, "en") for i, (t, _) in enumerate(made)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(made)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, 60)  # 1 of 9 rogues is toxic, but half of those in the sample
    score = toxicity.predict(model, ["a rogue spoke", plain() + " scoundrel"])
    assert score[0] < min(0.5, model["by_lang"]["en"]) and score[1] >= 0.5
    got = toxicity.calibration(docs, labels, model, [])
    known = [y for i, (_, y) in enumerate(made) if zlib.crc32(str(i).encode()) % 5]
    assert got["n"].sum() == len(known) and got["weight"][got["label"] == 1].sum() == sum(known)
    fitted = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5]
    got = toxicity.calibration(docs, labels, model, fitted)
    assert got["n"].sum() == len(known) - len(fitted) and got["weight"].sum() == pytest.approx(len(known))
    assert got["overall"].sum() == pytest.approx(len(known))


def test_quality_has_the_odds_of_all_labels(spark):
    made = [(i, f"good text {i}" if i % 7 else f"BAD!! {i}", int(i % 7 > 0)) for i in range(500)]
    docs = spark.createDataFrame([x[:2] + ("en",) for x in made], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in made] + [(9_999, 1)], "doc_id long, quality int")  # no such document
    known = [y for i, _, y in made if zlib.crc32(str(i).encode()) % 5]
    rows = quality.sample(docs, labels, "quality", 20, 1000).toPandas().sort_values(["label", "text"])
    assert rows["label"].sum() == 20 and len(rows) == 40
    plain = quality.fit(rows["text"].tolist(), rows["label"].to_numpy(float))
    got = quality.train(docs, labels, 20)
    assert got["w0"] - plain["w0"] == pytest.approx(np.log(sum(known) / (len(known) - sum(known))))


def test_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(i, t, "en") for i in range(30) for t in [f"text {i}"] * (500 if i == 7 else 1) + ["other"] * (i == 8)],
                                 "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, "toxic", 10, 1000).collect()
    assert len(got) == len({r.doc_id for r in got}) and {7, 8} <= {r.doc_id for r in toxicity.sample(docs, labels, "toxic", 30, 1000).collect()}
    assert len(toxicity.sample(docs, labels, "toxic", 30, 1000).collect()) == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(30))


def test_pages(spark):
    page = "<html><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>T &amp; U</h1><p>a  b<p><b>c<br>d</article><footer>f</footer>"
    got = pages.with_main_text(spark.createDataFrame(
        [(1, "http://h.x/1", page), (2, "http://h.x/2", page.replace("a  b", "z")), (3, None, None), (4, "http://h.x/3", page[:-60]),
         (5, "http://y.x", "<div><div>menu</div><div><p>text one</p><form>f</form><p>two</p></div></div>"), (1, "http://h.x/1", page)],
        "page_id long, url string, html string")).collect()
    text = {r.page_id: r._text for r in got}
    assert len(got) == 6 and text[1] == "T & U\na b\nc d" and text[2] == "T & U\nz\nc d" and text[3] == "" and "text one\ntwo" in text[5]
    a = compress(parse(page))
    assert len(align(a, compress(parse(page)))) == len(list(pages._slots(a)))


def test_empty_tables(spark, empty):
    assert ngram_join.with_component(empty).count() == 0 and substring.with_kept(empty).count() == 0
    assert sharding.sharded(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert fingerprint.with_next(fingerprint.fingerprints(empty), ["text"]).count() == 0
    assert lm_score.scored(empty, empty).count() == 0
    assert pages.with_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(empty, bench).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(empty, labels) is None and toxicity.not_toxic(empty, toxicity.train(empty, labels)).count() == 0


def test_sample_takes_long_texts_and_only_labels_of_documents(spark):
    made = [(i, "long " * 20_000 if i % 4 == 0 else f"short {i}", "en") for i in range(200)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(i, 1) for i in range(1000, 21_000)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, "toxic", 40, 10 ** 9).collect()
    assert sum(r.label == 1 for r in got) == 40 and sum(r.label == 0 for r in got) == 40
    assert any(len(r.text) == 100_000 for r in got)
    few = toxicity.sample(docs, labels, "toxic", 40, 250_000).collect()  # even ids are label 0, half of them long
    assert 250_000 <= sum(len(r.text) for r in few if r.label == 0) < 250_000 + 100_000 and {r.doc_id for r in few} < {r.doc_id for r in got}
