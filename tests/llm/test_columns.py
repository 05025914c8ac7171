"""Columns of the input may have any name, that of an operator's own column
included: they pass through untouched, and results are the same as without."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from salespanel.llm import decontaminate, mixing, ngram_join, pages, quality, sharding, substring, toxicity

NAMES = ("k_id k_hash k_component _id _hash _size _cell _depth _bytes _rows _part level node lo hi leaf bytes rows shard Shard shard_depth _mix_size "
         "_mix_source _mix_source_size _mix_target _mix_copies _mix_copy size source_size weight target total room _k k _starts starts _ends _cut cut _kept "
         "host _host ref refs slot _slot constant _constant _text key shape covered words hits items hit found at _text_hash text_hash cls rep component "
         "component_id least last gid tile band _toxicity _quality row label fitted given __column_1 DOC_TYPE").split()

LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [(1, LONG, "en", "a", 9), (2, LONG + " tail", "en", "a", 9), (3, "one two three", "de", "b", 9), (4, None, None, None, None),
        (5, "benchmark words stand here", "en", "b", 9), (6, "", "en", "a", 0), (6, "", "en", "a", 0)]


@pytest.fixture(scope="module")
def plain(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="module")
def crowded(plain):
    taken = {c.lower() for c in plain.columns}
    extra, seen = [], set(taken)
    for i, n in enumerate(NAMES):
        if n.lower() not in seen:
            seen.add(n.lower())
            extra.append(F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) if i % 3 else F.lit(i).alias(n))
    return plain.select(*extra, *plain.columns)


OPERATORS = {
    "sharded": lambda s, d: sharding.sharded(d, 100),
    "mix_rates": lambda s, d: mixing.mix_rates(d),
    "mixed": lambda s, d: mixing.mixed(d),
    "decontaminated": lambda s, d: decontaminate.decontaminated(d, bench(s)),
    "decontaminated_spans": lambda s, d: decontaminate.decontaminated(d, bench(s), remove="spans"),
    "one_of_each": lambda s, d: ngram_join.one_of_each(d),
    "with_kept": lambda s, d: substring.with_kept(d),
    "with_quality": lambda s, d: quality.with_quality(d, None),
    "with_toxicity": lambda s, d: toxicity.with_toxicity(d, None),
    "not_toxic": lambda s, d: toxicity.not_toxic(d, None),
    "with_component": lambda s, d: ngram_join.with_component(d),
    "report": lambda s, d: decontaminate.report(d, bench(s)),
}


def bench(spark):
    return spark.createDataFrame([(1, "benchmark words stand", "x")], "item_id long, text string, words string")


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_operator(spark, plain, crowded, name):
    run = OPERATORS[name]
    want, got = run(spark, plain), run(spark, crowded)
    assert [c for c in got.columns if c in want.columns] == want.columns or set(want.columns) <= set(got.columns)
    assert len({c.lower() for c in got.columns}) == len(got.columns)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    passed = [c for c in crowded.columns if c in got.columns and c not in want.columns]
    if passed and name != "report":
        before = {str(r) for r in crowded.select("doc_id", *passed).collect()}
        assert {str(r) for r in got.select("doc_id", *passed).collect()} <= before
        assert set(crowded.columns) - set(got.columns) == set() or name == "with_component"


def test_pages(spark):
    rows = [(1, "http://x.y/1", "<article><p>one</p></article>"), (2, None, None)]
    plain = spark.createDataFrame(rows, "page_id long, url string, html string")
    names = [n for n in NAMES if n.lower() not in ("shard",)]
    crowded = plain.select(*[F.lit(i).alias(n) for i, n in enumerate(names)], "*")
    got = pages.with_main_text(crowded)
    assert sorted(map(str, got.select("page_id", "_text").collect())) == sorted(map(str, pages.with_main_text(plain).select("page_id", "_text").collect()))
    assert set(names) <= set(got.columns) and got.columns.count("_text") == 1


@pytest.mark.parametrize("kind", ["nulls", "clash", "empty"])
def test_pipeline(spark, plain, crowded, tmp_path, kind):
    """The pipeline as a whole on null columns, odd names and empty tables."""
    docs = {"nulls": plain, "clash": crowded, "empty": plain.limit(0)}[kind]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    (labels if kind != "empty" else labels.limit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    (bench(spark) if kind != "empty" else bench(spark).limit(0)).write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    rows = out.collect()
    assert {r.doc_id for r in rows} <= {1, 3, 4, 6} and (kind == "empty") == (not rows)
    kept = [c for c in docs.columns if c.lower() not in ("shard", "shard_depth", "shard_bytes")]
    assert [c for c in out.columns if c in kept] == kept
