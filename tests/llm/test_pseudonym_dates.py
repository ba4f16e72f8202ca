"""Dates in either order, with one-digit fields and two-digit years."""

import datetime as dt
import re

import pytest

from stromlage.llm import pseudonyms as ps


def pseudonyms(spark, values):
    docs = spark.createDataFrame([(v,) for v in values], "text string")
    return [r.text for r in ps.pseudonymise(docs, "k").collect()]


def read(v):
    """(date, whether the order is the usual one), or None."""
    a, b, c = re.split("[-/.]", v)
    y, pair, month_first = (a, (b, c), True) if len(a) == 4 else (c, (a, b), "/" in v)
    for usual in (True, False):
        mo, da = pair if month_first == usual else pair[::-1]
        try:
            return dt.date(int(y) + (2000 if len(y) == 2 else 0), int(mo), int(da)), usual
        except ValueError:
            pass
    return None


FORMS = ["31/12/2019", "12-31-2019", "12.31.2019", "3/4/2019", "5.6.2019", "25.3.2019", "3/25/2019", "25/3/2019", "2019-3-4",
         "2019-31-12", "31/12/19", "05.06.19", "5.6.19", "29/2/2020", "29/02/2020", "28/2/2019", "10.1.2000", "1/10/2000"]


@pytest.mark.parametrize("at", range(3))
def test_forms(spark, at):
    for old, new in zip(FORMS[at::3], pseudonyms(spark, FORMS[at::3]), strict=True):
        assert old != new and read(new) is not None, (old, new)
        assert re.sub("[0-9]", "0", old) == re.sub("[0-9]", "0", new)
        assert read(old)[1] == read(new)[1]


def test_what_is_no_date_stays(spark):
    values = ["32/12/2019", "13/13/2019", "30/2/2019", "29/2/2019", "0/4/2019", "1.2.3.4.5", "3/4/1899", "31.4.19", "1/2/123"]
    assert pseudonyms(spark, values) == values


def test_one_to_one(spark):
    days = [dt.date(1900, 1, 1) + dt.timedelta(7 * k) for k in range(3000)]
    values = sorted({v for d in days for v in (
        f"{d.day}/{d.month}/{d.year}", f"{d.month}/{d.day}/{d.year}", f"{d:%d/%m/%Y}", f"{d:%m/%d/%Y}")})
    new = pseudonyms(spark, values)
    assert len(set(new)) == len(values) and all(read(v) for v in new)
