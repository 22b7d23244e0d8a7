"""Movable feasts and number words against independent statements."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from ripplekit.functions import dates as D
from ripplekit.functions import text as X

EASTER = {1818: (3, 22), 1943: (4, 25), 1954: (4, 18), 1981: (4, 19), 1995: (4, 16), 2000: (4, 23), 2008: (3, 23), 2011: (4, 24), 2018: (4, 1),
          2019: (4, 21), 2020: (4, 12), 2021: (4, 4), 2022: (4, 17), 2023: (4, 9), 2024: (3, 31), 2025: (4, 20), 2038: (4, 25)}


def test_easter(spark):
    got = {r.y: r.e for r in spark.createDataFrame([(y,) for y in EASTER], "y int").select("y", D.easter("y").alias("e")).collect()}
    assert got == {y: dt.date(y, m, d) for y, (m, d) in EASTER.items()}


def test_holidays_of_two_states(spark):
    rows = [(s, dt.date(2019, 1, 1) + dt.timedelta(i)) for s in ("BY", "SN", None) for i in range(365)]
    got = {(r.state, str(r.day)[5:]): r.holiday for r in D.with_holiday(spark.createDataFrame(rows, "state string, day date")).collect()}
    assert len(got) == 3 * 365
    both = {"01-01": "New Year", "04-19": "Good Friday", "04-22": "Easter Monday", "05-01": "Labour Day", "05-30": "Ascension",
            "06-10": "Whit Monday", "10-03": "German Unity", "12-25": "Christmas", "12-26": "Second Christmas Day"}
    assert {d: h for (s, d), h in got.items() if s == "BY" and h} == {**both, "01-06": "Epiphany", "06-20": "Corpus Christi", "11-01": "All Saints"}
    assert {d: h for (s, d), h in got.items() if s == "SN" and h} == {**both, "10-31": "Reformation", "11-20": "Repentance"}
    assert not any(h for (s, _), h in got.items() if s is None)
    new = D.holiday_dates(spark.createDataFrame([(2018,), (2022,), (2023,)], "year int")).where("state in ('MV', 'BE', 'HH', 'SN')").collect()
    assert {(r.state, r.day.year) for r in new if r.holiday == "Women's Day"} == {("BE", 2022), ("BE", 2023), ("MV", 2023)}
    assert {r.day for r in new if r.holiday == "Repentance"} == {dt.date(2018, 11, 21), dt.date(2022, 11, 16), dt.date(2023, 11, 22)}


NUMBERS = {"one hundred": 100, "twenty five": 25, "twenty-five": 25, "thirteen": 13, "one thousand": 1000, "three hundred and forty-two": 342,
           "two thousand five hundred": 2500, "twelve hundred": None, "one hundred and one thousand and one": 101001, "hundred": 100, "ten": 10,
           "two million": 2_000_000, "Ninety  Nine": 99, "five five": None, "ten five": None, "twenty ten": None, "forty two people": None,
           "": None, "and": None, "six hundred thousand": 600_000, "thousand": 1000}


def test_number_words(spark):
    df = spark.createDataFrame([(k,) for k in [*NUMBERS, None]], "s string")
    got = {r.s: r.n for r in df.select("s", X.number_words("s").alias("n")).collect()}
    assert got.pop(None) is None and got == NUMBERS
    more = {"about three hundred people": 300, "two hundred and fifty dozen": 3000, "at least a thousand": 5000, "fifteen cars": 15, "zero": None}
    df = spark.createDataFrame([(k,) for k in more], "s string")
    assert {r.s: r.n for r in df.select("s", X.parse_quantity("s").alias("n")).collect()} == more
    assert {r.s: r.n for r in X.with_parsed_quantity(df, "s", "n").collect()} == more


def test_parse_quantity_cleans_a_text_once(spark):
    plan = spark.createDataFrame([("x",)], "s string").select(X.parse_quantity("s").alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") + plan.count("regexp_extract(") < 20
    affixed = {"around about ten people": 10, "about around ten cars": None, "ten people of": None, "ten of people": 10, "ten cars\n": None,
               "a several": None, "about ten of\n people": None, "several a dozen": 50, "1,200 to 1,300 people": 1250, "a 7": 7}
    df = spark.createDataFrame([(k,) for k in affixed], "s string")
    assert {r.s: r.n for r in df.select("s", X.parse_quantity("s").alias("n")).collect()} == affixed


@pytest.mark.parametrize("text,want", [("a [size=around 160] b", "around 160"), ("armed; crowd size=no report", "no report"), ("size= 5 ", "5"),
                                       ("nothing", None), (None, None), ("[size=]", None)])
def test_size_tags(spark, text, want):
    got = spark.createDataFrame([(text,)], "s string").select(X.size_tag("s")).first()[0]
    assert got == want or (text == "[size=]" and got in (None, "]"))


def test_date_line(spark):
    r = spark.createDataFrame([("BY", dt.date(2021, 12, 25), "Christmas"), ("SN", dt.date(2021, 3, 5), None)], "s string, day date, h string")
    assert [x[0] for x in r.select(D.day_line("s", "day", "h")).collect()] == ["BY, Saturday, 25. December 2021, Christmas", "SN, Friday, 5. March 2021"]
