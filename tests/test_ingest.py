"""Raw CSV sources, parsing rules and the join contract."""

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from salespanel.functions.scalar import coerce_bool, parse_date, typed
from salespanel.operators import contract as con
from salespanel.operators import ingest as ing
from salespanel.sources.raw import load_raw_tables
from tests.conftest import d

STORES = "Store,Type,Size\n1,A,151315\n2,B,202307\n"
FEATURES = ("Store,Date,Temperature,Fuel_Price,MarkDown1,MarkDown2,MarkDown3,MarkDown4,MarkDown5,CPI,Unemployment,IsHoliday\n"
            "1,05/02/2010,42.31,2.572,NA,NA,NA,NA,NA,211.0963582,8.106,FALSE\n"
            "1,12/02/2010,38.51,2.548,NA,NA,NA,NA,NA,211.2421698,8.106,TRUE\n"
            "2,05/02/2010,40.19,2.572,10.5,,NaN,n/a,1.0,210.7526053,8.324,FALSE\n")
TRAIN = ("Store,Dept,Date,Weekly_Sales,IsHoliday\n"
         "1,1,05/02/2010,24924.5,FALSE\n"
         "1,1,12/02/2010,46039.49,TRUE\n"
         "2,1,5/2/2010,10000.0, false \n"
         "2,2,31/02/2010,5.0,FALSE\n"
         "2,3,05/02/2010,NA,FALSE\n")


def write_raw(tmp_path, stores=STORES, features=FEATURES, train=TRAIN):
    for name, text in (("stores.csv", stores), ("features.csv", features), ("train.csv", train)):
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_parse_date_rules(spark):
    df = spark.createDataFrame([("05/02/2010",), ("5/2/2010",), ("31/02/2010",), ("2010-02-05",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_date("t")).collect()]
    assert got == [d("2010-02-05"), d("2010-02-05"), None, None, None]


def test_null_tokens_and_numbers(spark):
    df = spark.createDataFrame([("NA",), ("NaN",), ("n/a",), ("",), ("1.5",), ("Infinity",)], "t string")
    got = [r[0] for r in df.select(typed("t", "double")).collect()]
    assert got[:4] == [None] * 4 and got[4] == 1.5 and got[5] == float("inf")


def test_coerce_bool(spark):
    df = spark.createDataFrame([(" false ",), ("TRUE",), ("True",), ("yes",), (None,)], "t string")
    assert [r[0] for r in df.select(coerce_bool("t")).collect()] == [False, True, True, None, None]
    assert [r[0] for r in df.select(coerce_bool("t", unknown="true")).collect()] == [False, True, True, True, True]


def test_csv_ingest_end_to_end(spark, tmp_path):
    src = load_raw_tables(spark, write_raw(tmp_path))
    obs = Observation("x")
    clean = ing.ingest(src, observation=obs)
    rows = sorted(clean.collect(), key=lambda r: (r.Store, r.Dept, r.Date))
    assert clean.columns[:7] == ["Store", "Dept", "Date", "Weekly_Sales", "IsHoliday", "Type", "Size"]
    assert len(clean.columns) == 16
    assert len(rows) == 3            # bad date and null target dropped
    assert obs.get["rows_in"] == 5 and obs.get["rows_out"] == 3
    r2 = [r for r in rows if r.Store == 2][0]
    assert r2.Date == d("2010-02-05") and r2.IsHoliday is False and r2.Type == "B"
    assert r2.MarkDown1 == 10.5 and r2.MarkDown2 is None and r2.MarkDown3 is None and r2.MarkDown4 is None
    assert rows[1].IsHoliday is True   # train's flag wins
    assert dict(clean.dtypes)["Store"] == "bigint" and dict(clean.dtypes)["Date"] == "date"
    contract = {"primary_keys": ["Store", "Dept", "Date"], "target_column": "Weekly_Sales",
                "columns": {"Store": {"dtype": "int", "nullable": False},
                            "Weekly_Sales": {"dtype": "float", "nullable": False, "min": -5000, "max": 800000}}}
    assert con.validate(clean, contract).status == "PASS"


def test_missing_files_are_all_listed(spark, tmp_path):
    (tmp_path / "stores.csv").write_text(STORES)
    with pytest.raises(ing.DataIngestionError) as e:
        load_raw_tables(spark, str(tmp_path))
    assert "features.csv" in str(e.value) and "train.csv" in str(e.value)
    with pytest.raises(ing.DataIngestionError):
        load_raw_tables(spark, str(tmp_path / "does_not_exist"))


def test_repeated_right_key_fails(spark, tmp_path):
    src = load_raw_tables(spark, write_raw(tmp_path, stores=STORES + "2,C,1\n"))
    with pytest.raises(ing.DataIngestionError, match="Store=2"):
        ing.ingest(src)


def test_repeated_feature_key_fails(spark, tmp_path):
    feats = FEATURES + "1,05/02/2010,1,1,NA,NA,NA,NA,NA,1,1,FALSE\n"
    src = load_raw_tables(spark, write_raw(tmp_path, features=feats))
    v = ing.join_key_violations(src["stores"], src["features"]).collect()
    assert [(r.source, r.Store, r.Date, r.n) for r in v] == [("features", 1, d("2010-02-05"), 2)]


def test_unmatched_store_keeps_row(spark, tmp_path):
    train = TRAIN + "9,1,05/02/2010,1.0,FALSE\n"
    clean = ing.ingest(load_raw_tables(spark, write_raw(tmp_path, train=train)))
    r = clean.filter(F.col("Store") == 9).first()
    assert r.Type is None and r.Temperature is None


def test_select_stores_pushes_down(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0), (4, 4.0)], "Store int, Weekly_Sales double")
    df.write.parquet(str(tmp_path / "t"))
    sub = ing.select_stores(spark.read.parquet(str(tmp_path / "t")), [1, 2, 3])
    assert sorted(r.Store for r in sub.collect()) == [1, 2, 3]
    plan = sub._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(Store" in plan or "PushedFilters: [IsNotNull(Store), In(Store" in plan


def test_clean_csv_export_round_trip(spark, tmp_path):
    import json

    from salespanel.plans.pipeline import validate_paths
    from salespanel.sources.raw import read_clean, read_text_csv, type_columns, write_clean
    from salespanel.schemas import CLEAN_COLUMNS
    clean = ing.ingest(load_raw_tables(spark, write_raw(tmp_path)))
    write_clean(clean, str(tmp_path / "clean"), globally_sorted=True, csv_path=str(tmp_path / "clean_csv"))
    back = read_clean(spark, str(tmp_path / "clean"))
    assert sorted(back.collect()) == sorted(clean.collect())
    # the CSV export parses back to the same rows (dates written as ISO text)
    types = {"Store": "int", "Dept": "int", "Weekly_Sales": "double", "Size": "int"}
    txt = type_columns(read_text_csv(spark, str(tmp_path / "clean_csv")), types)
    assert txt.columns == list(CLEAN_COLUMNS)
    assert sorted((r.Store, r.Dept, r.Date, r.Weekly_Sales) for r in txt.collect()) == \
        sorted((r.Store, r.Dept, r.Date.isoformat(), r.Weekly_Sales) for r in clean.collect())
    contract = {"primary_keys": ["Store", "Dept", "Date"], "target_column": "Weekly_Sales",
                "columns": {"Store": {"dtype": "int", "nullable": False},
                            "Weekly_Sales": {"dtype": "float", "nullable": False, "min": 0, "max": 30000}}}
    (tmp_path / "contract.json").write_text(json.dumps(contract))
    r = validate_paths(spark, str(tmp_path / "clean"), str(tmp_path / "contract.json"))
    assert r.status == "FAIL" and any("maximum of 30000" in e for e in r.errors)


def test_integer_text_forms(spark):
    df = spark.createDataFrame([("12",), ("12.0",), ("1.2e1",), ("12.5",), ("NA",), ("x",), ("99999999999",)], "t string")
    assert [r[0] for r in df.select(typed("t", "int")).collect()] == [12, 12, 12, None, None, None, None]


def test_unknown_bool_option_reaches_the_run(spark, tmp_path):
    from salespanel.plans.pipeline import run_pipeline
    train = TRAIN.replace("1,1,12/02/2010,46039.49,TRUE", "1,1,12/02/2010,46039.49,yes")
    st = run_pipeline(spark, raw_dir=write_raw(tmp_path, train=train), artifacts_root=str(tmp_path / "a"),
                      run_id="r-null", num_trees=2, max_depth=2)
    assert st.status == "FAILED" and any("IsHoliday" in e and "non-nullable" in e for e in st.validation_errors)


def test_nan_is_null_after_ingest(spark):
    train = spark.createDataFrame([(1, 1, d("2010-02-05"), float("nan"), False),
                                   (1, 2, d("2010-02-05"), 3.0, False)],
                                  "Store int, Dept int, Date date, Weekly_Sales double, IsHoliday boolean")
    stores = spark.createDataFrame([(1, "A", 10)], "Store int, Type string, Size int")
    feats = spark.createDataFrame([(1, d("2010-02-05"), float("nan"))], "Store int, Date date, CPI double")
    clean = ing.ingest({"stores": stores, "features": feats, "train": train})
    rows = clean.collect()
    assert len(rows) == 1 and rows[0].Weekly_Sales == 3.0 and rows[0].CPI is None


def test_nan_target_dropped_with_observation(spark):
    train = spark.createDataFrame([(1, 1, d("2010-02-05"), float("nan"), False),
                                   (1, 2, d("2010-02-05"), 3.0, False)],
                                  "Store int, Dept int, Date date, Weekly_Sales double, IsHoliday boolean")
    stores = spark.createDataFrame([(1, "A", 10)], "Store int, Type string, Size int")
    feats = spark.createDataFrame([(1, d("2010-02-05"), 1.0)], "Store int, Date date, CPI double")
    obs = Observation("nan-obs")
    rows = ing.ingest({"stores": stores, "features": feats, "train": train}, observation=obs).collect()
    assert len(rows) == 1 and obs.get["rows_in"] == 2 and obs.get["rows_out"] == 1


def test_whole_numbers_keep_64_bits(spark):
    from salespanel.functions.scalar import typed
    rows = [("3000000000", 3000000000), ("9007199254740993", 9007199254740993), (" 12.0 ", 12), ("1.2e1", 12), ("1.5", None),
            ("1d", None), ("0x1p3", None), ("inf", None), ("99999999999999999999", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, want long").select("want", typed("t", "bigint").alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_store_join_is_broadcast_by_measured_size(spark):
    from salespanel.operators.ingest import broadcast_if_small
    stores = spark.createDataFrame([(1, "A", 5), (2, None, 6)], "Store long, Type string, Size long")
    hinted = broadcast_if_small(stores)._jdf.queryExecution().logical().toString()
    plain = broadcast_if_small(stores, limit=10)._jdf.queryExecution().logical().toString()
    assert "broadcast" in hinted.lower() and "broadcast" not in plain.lower()
