"""Contract validation (ported cases of the reference plus edge rules)."""

import pytest

from salespanel.operators import contract as con
from tests.conftest import d

GOOD_DDL = "Store int, Dept int, Date date, Weekly_Sales double, IsHoliday boolean"


def base_contract():
    return {
        "primary_keys": ["Store", "Dept", "Date"],
        "target_column": "Weekly_Sales",
        "columns": {
            "Store": {"dtype": "int", "nullable": False},
            "Dept": {"dtype": "int", "nullable": False},
            "Date": {"dtype": "datetime", "nullable": False},
            "Weekly_Sales": {"dtype": "float", "nullable": False, "min": -5000, "max": 800000},
            "IsHoliday": {"dtype": "bool", "nullable": False},
        },
    }


def good_rows():
    return [(1, 1, d("2010-02-05"), 24924.5, False),
            (1, 2, d("2010-02-05"), 46039.49, True),
            (2, 1, d("2010-02-05"), 10000.0, False)]


def good_df(spark, rows=None, ddl=GOOD_DDL):
    return spark.createDataFrame(rows if rows is not None else good_rows(), ddl)


def test_passes_on_clean_data(spark):
    r = con.validate(good_df(spark), base_contract())
    assert r.status == "PASS" and r.errors == []


def test_fails_on_missing_column(spark):
    r = con.validate(good_df(spark).drop("IsHoliday"), base_contract())
    assert r.status == "FAIL" and any("IsHoliday" in e for e in r.errors)


def test_fails_on_null_primary_key(spark):
    rows = good_rows()
    rows[0] = (1, None, *rows[0][2:])
    r = con.validate(good_df(spark, rows), base_contract())
    assert r.status == "FAIL" and any("primary key" in e for e in r.errors)
    assert any("non-nullable" in e and "Dept" in e for e in r.errors)


def test_fails_on_null_target(spark):
    rows = good_rows()
    rows[0] = (*rows[0][:3], None, rows[0][4])
    r = con.validate(good_df(spark, rows), base_contract())
    assert r.status == "FAIL" and any("Weekly_Sales" in e and "null" in e for e in r.errors)


def test_fails_on_duplicate_primary_key(spark):
    rows = good_rows() + [good_rows()[0]]
    r = con.validate(good_df(spark, rows), base_contract())
    assert r.status == "FAIL" and any("duplicate" in e for e in r.errors)
    assert any(e.startswith("1 duplicate") for e in r.errors)


def test_fails_on_out_of_bounds_target(spark):
    rows = good_rows()
    rows[0] = (*rows[0][:3], 5_000_000.0, rows[0][4])
    r = con.validate(good_df(spark, rows), base_contract())
    assert r.status == "FAIL" and any("maximum" in e for e in r.errors)


def test_fails_below_minimum(spark):
    rows = good_rows()
    rows[0] = (*rows[0][:3], -6000.0, rows[0][4])
    r = con.validate(good_df(spark, rows), base_contract())
    assert r.status == "FAIL" and any("minimum" in e for e in r.errors)


def test_bounds_are_strict(spark):
    rows = good_rows()
    rows[0] = (*rows[0][:3], 800000.0, rows[0][4])
    rows[1] = (*rows[1][:3], -5000.0, rows[1][4])
    assert con.validate(good_df(spark, rows), base_contract()).status == "PASS"


def test_fails_on_wrong_dtype(spark):
    rows = [(f"{r[0]}abc", *r[1:]) for r in good_rows()]
    df = good_df(spark, rows, GOOD_DDL.replace("Store int", "Store string"))
    r = con.validate(df, base_contract())
    assert r.status == "FAIL" and any("Store" in e and "dtype" in e for e in r.errors)


def test_unknown_dtype_is_a_warning(spark):
    c = base_contract()
    c["columns"]["Store"]["dtype"] = "uuid"
    r = con.validate(good_df(spark), c)
    assert r.status == "PASS" and any("uuid" in w for w in r.warnings)


def test_missing_pk_and_target(spark):
    c = base_contract()
    df = good_df(spark).drop("Weekly_Sales").drop("Dept")
    r = con.validate(df, c)
    assert any("Primary key column 'Dept'" in e for e in r.errors)
    assert any("Target column 'Weekly_Sales' not present" in e for e in r.errors)


@pytest.mark.parametrize("ddl,rows,declared,ok", [
    ("c long", [(1,), (2,), (None,)], "int", True),
    ("c double", [(1.0,), (2.0,)], "int", True),
    ("c double", [(1.5,)], "int", False),
    ("c double", [(float("inf"),)], "int", False),
    ("c long", [(0,), (1,)], "bool", True),
    ("c long", [(2,)], "bool", False),
    ("c double", [(1.5,)], "float", True),
    ("c boolean", [(True,)], "int", True),
    ("c boolean", [(True,)], "bool", True),
    ("c boolean", [(True,)], "datetime", False),
    ("c date", [(d("2010-01-01"),)], "datetime", True),
    ("c date", [(d("2010-01-01"),)], "int", False),
    ("c long", [(5,)], "datetime", False),
    ("c string", [("12",), ("3",)], "int", True),
    ("c string", [("1.5",)], "int", False),
    ("c string", [("1.5",)], "float", True),
    ("c string", [("2010-02-05",)], "datetime", True),
    ("c string", [("05/02/2010x",)], "datetime", False),
    ("c string", [("12",)], "datetime", False),
    ("c string", [("2010-02-05 10:30:00",)], "datetime", True),
    ("c string", [("2010-02-05",), ("05/02/2010",)], "datetime", False),
    ("c string", [("TRUE",), ("False",)], "bool", True),
    ("c string", [("true",)], "bool", False),
    ("c string", [("abc",)], "float", False),
    ("c string", [(None,)], "int", True),
    ("c string", [("anything",)], "string", True),
])
def test_dtype_matrix(spark, ddl, rows, declared, ok):
    df = spark.createDataFrame(rows, ddl)
    c = {"primary_keys": [], "columns": {"c": {"dtype": declared}}}
    assert (con.validate(df, c).status == "PASS") == ok


def test_contract_bounds_fallback_without_target(spark):
    df = spark.createDataFrame([(1, None)], "Store int, Weekly_Sales double")
    b = con.contract_bounds(df).first()
    assert b["min_bound"] == -5000.0 and b["max_bound"] == 800000.0


def test_contract_bounds_margin(spark):
    df = spark.createDataFrame([(-10000.0,), (1000000.0,)], "Weekly_Sales double")
    b = con.contract_bounds(df).first()
    assert b["min_bound"] == -11000.0 and b["max_bound"] == 1100000.0


def test_checks_table_and_verdict(spark):
    rows = good_rows() + [good_rows()[0]]
    checks = con.contract_checks(good_df(spark, rows), base_contract())
    got = {(r.rule, r.column_name): r.violations for r in checks.collect()}
    assert got[("pk_duplicate", "Store,Dept,Date")] == 1
    assert got[("above_max", "Weekly_Sales")] == 0
    v = con.contract_verdict(checks).first()
    assert v.status == "FAIL" and v.n_errors == 1
