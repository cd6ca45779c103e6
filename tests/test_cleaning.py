import datetime as dt

import pytest
from pyspark.sql import functions as F

from sentria.functions import cleaning as c


def test_dates_of_two_digit_years(spark):
    cases = {
        "05-JAN-68": dt.date(1968, 1, 5), "31-DEC-50": dt.date(2050, 12, 31), "01-JAN-51": dt.date(1951, 1, 1),
        "29-FEB-00": dt.date(2000, 2, 29), "1-Mar-99": dt.date(1999, 3, 1), "bad": None, None: None,
    }
    t = spark.createDataFrame([(k,) for k in cases], "d string")
    for r in t.select("d", c.clean_date("d").alias("o")).collect():
        assert r.o == cases[r.d]


def test_age_groups_at_the_limits(spark):
    cases = [(0.0, "Neonate"), (25 / 365, "Neonate"), (25 / 365 + 1e-9, "Infant"), (1.0, "Child"), (13.0, "Adolescent"),
             (18.0, "Adult"), (65.0, "Adult"), (65.01, "Elderly"), (101.0, "Elderly"), (None, "Unknown")]
    t = spark.createDataFrame(cases, "a double, e string")
    assert all(r.g == r.e for r in t.select("e", c.age_group("a").alias("g")).collect())


def test_ids_are_never_cut(spark):
    t = spark.createDataFrame([("7",), ("1234567890",), ("123456789",)], "i string")
    assert [r.o for r in t.select(c.pad_id("i").alias("o")).collect()] == ["\t000000007", "\t1234567890", "\t123456789"]


def test_onset_units(spark):
    rows = [(3.0, "800", 30.0), (3.0, "801", 3.0), (6.0, "802", 0.5), (26.0, "803", 0.5), (73.0, "804", 0.2),
            (876.0, "805", 0.1), (3.0, None, None), (None, "801", None), (3.0, "999", None)]
    t = spark.createDataFrame(rows, "a double, u string, e double")
    for r in t.select("e", c.onset_age_years("a", "u").alias("y")).collect():
        assert r.y == r.e or abs(r.y - r.e) < 1e-12


def test_quarters_round_trip(spark):
    t = spark.createDataFrame([(dt.date(2006, 3, 31),), (dt.date(2006, 4, 1),)], "d date")
    key = c.quarter_key("d")
    rows = t.select(key.alias("k"), c.quarter_label(key).alias("l"), c.quarter_start(key).alias("s"),
                    c.quarter_from_label(c.quarter_label(key)).alias("b")).collect()
    assert [tuple(r) for r in rows] == [(20061, "2006.1", dt.date(2006, 1, 1), 20061), (20062, "2006.2", dt.date(2006, 4, 1), 20062)]


def test_completeness(spark):
    t = spark.createDataFrame([("a",), (None,)], "g string")
    with pytest.raises(ValueError, match="1 rows"):
        c.require_complete(t, "g")
    with pytest.raises(Exception, match="no g"):
        c.checked_complete(t, "g").collect()
    assert c.require_complete(t.filter("g is not null"), "g").count() == 1


def test_terms_and_ingredients(spark):
    t = spark.createDataFrame([("A|B",), ("B|C",), ("50%",), ("x,y",)], "ing string")
    assert sorted(r.ing for r in c.drop_terms(t, "ing").collect()) == ["A|B", "B|C"]
    assert sorted(r.ing for r in c.explode_ingredients(t.filter(F.col("ing").contains("|"))).collect()) == ["A", "B", "C"]
