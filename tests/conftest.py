import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from salespanel.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", shuffle_partitions=8)
    yield s


def d(s: str) -> dt.date:
    return dt.date.fromisoformat(s)


CLEAN_DDL = ("Store int, Dept int, Date date, Weekly_Sales double, IsHoliday boolean, Type string, "
             "Size int, Temperature double, Fuel_Price double, MarkDown1 double, MarkDown2 double, "
             "MarkDown3 double, MarkDown4 double, MarkDown5 double, CPI double, Unemployment double")


def series_rows(store=1, dept=1, sales=None, start="2010-01-01", typ="A", md1=None, holidays=None,
                dates=None):
    sales = sales if sales is not None else [100.0 + 10 * i for i in range(12)]
    n = len(sales)
    dates = dates or [d(start) + dt.timedelta(days=7 * i) for i in range(n)]
    md1 = md1 if md1 is not None else [None] * 6 + [10.0] * (n - 6)
    holidays = holidays or [False] * n
    return [(store, dept, dates[i], sales[i], holidays[i], typ, 100000, 50.0, 3.0, md1[i], None, None,
             None, None, 200.0, 8.0) for i in range(n)]
