"""Date helpers."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed-date public holidays (month-day).  National days apply
# to every unit; regional days only to the listed areas.
NATIONAL_HOLIDAYS = ["01-01", "05-01", "10-03", "12-25", "12-26"]
REGIONAL_HOLIDAYS = {"EUROPE": ["01-06", "11-01"], "AMERICA": ["10-31"]}

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def weekday_name(day) -> Column:
    day = F.col(day) if isinstance(day, str) else day
    return F.date_format(day, "EEEE")


def holiday_flag(day, area, national=None, regional=None) -> Column:
    """1 when the day is a public holiday in the unit's area — a pure
    column expression (no holiday table join)."""
    national = NATIONAL_HOLIDAYS if national is None else national
    regional = REGIONAL_HOLIDAYS if regional is None else regional
    day = F.col(day) if isinstance(day, str) else day
    area = F.col(area) if isinstance(area, str) else area
    md = F.date_format(day, "MM-dd")
    cond = md.isin(national)
    for a, days in regional.items():
        cond = cond | ((area == a) & md.isin(days))
    return cond.cast("int")


# German public holidays: name, month-day or days from Easter Sunday, states (None: all), first year.
HOLIDAYS = [
    ("New Year", "01-01", None, 0), ("Epiphany", "01-06", "BW BY ST", 0), ("Women's Day", "03-08", "BE", 2019),
    ("Women's Day", "03-08", "MV", 2023), ("Good Friday", -2, None, 0), ("Easter Sunday", 0, "BB", 0), ("Easter Monday", 1, None, 0),
    ("Labour Day", "05-01", None, 0), ("Ascension", 39, None, 0), ("Whit Sunday", 49, "BB", 0), ("Whit Monday", 50, None, 0),
    ("Corpus Christi", 60, "BW BY HE NW RP SL", 0), ("Assumption", "08-15", "SL", 0), ("Children's Day", "09-20", "TH", 2019),
    ("German Unity", "10-03", None, 1990), ("Reformation", "10-31", "BB MV SN ST TH", 0), ("Reformation", "10-31", "HB HH NI SH", 2018),
    ("All Saints", "11-01", "BW BY NW RP SL", 0), ("Christmas", "12-25", None, 0), ("Second Christmas Day", "12-26", None, 0),
]
REPENTANCE_STATES = "SN"  # the Wednesday before 23 November


def easter(year) -> Column:
    """Easter Sunday of a year as integer column arithmetic (Gregorian computus)."""
    y = (F.col(year) if isinstance(year, str) else year).cast("int")
    div = lambda a, b: F.floor(a / b).cast("int")
    golden, century, of = y % 19, div(y, 100), y % 100
    leap, moon = div(century, 4), div(century - div(century + 8, 25) + 1, 3)
    epact = (19 * golden + century - leap - moon + 15) % 30
    sunday = (32 + 2 * (century % 4) + 2 * div(of, 4) - epact - of % 4) % 7
    late = div(golden + 11 * epact + 22 * sunday, 451)
    place = epact + sunday - 7 * late + 114
    return F.make_date(y, div(place, 31), place % 31 + 1)


def holiday_dates(years, year: str = "year"):
    """(state, day, holiday) for every year of ``years`` (distinct ones): the rules exploded beside each year's Easter,
    a table of years x rules rows.  Of two holidays on one day the earlier rule's name stays."""
    states = "BW BY BE BB HB HH HE MV NI NW RP SL SN ST SH TH"
    rules = [(rank, title, when if isinstance(when, int) else None, None if isinstance(when, int) else when, state, first)
             for rank, (title, when, where, first) in enumerate(HOLIDAYS) for state in (where or states).split()]
    rules += [(len(HOLIDAYS), "Repentance", None, None, state, 0) for state in REPENTANCE_STATES.split()]
    names = ("rank", "holiday", "after", "md", "state", "first")
    rules = F.from_json(F.lit(json.dumps([dict(zip(names, r)) for r in rules])),
                        "array<struct<rank:int,holiday:string,after:int,md:string,state:string,first:int>>")
    d = years.select(F.col(year).alias("year"), easter(year).alias("easter")).select("*", F.inline(rules)).where("year >= first")
    last = F.make_date("year", F.lit(11), F.lit(22))  # the Wednesday of the week that ends on it
    fixed = F.to_date(F.concat_ws("-", F.col("year").cast("string"), "md"))
    day = F.when(F.col("after").isNotNull(), F.date_add("easter", F.col("after"))).when(F.col("md").isNotNull(), fixed) \
        .otherwise(F.date_sub(last, (F.dayofweek(last) + 3) % 7))
    return d.groupBy("state", day.alias("day")).agg(F.min(F.struct("rank", "holiday"))["holiday"].alias("holiday"))


def with_holiday(df, day: str = "day", state: str = "state", out: str = "holiday"):
    """the name of the public holiday in a state (null: none), for the years of ``df``'s days."""
    dates = holiday_dates(df.select(F.year(day).alias("year")).distinct()).select(F.col("state").alias("_s"), F.col("day").alias("_d"),
                                                                                  F.col("holiday").alias(out))
    return df.join(F.broadcast(dates), [F.col(state) == F.col("_s"), F.col(day) == F.col("_d")], "left").drop("_s", "_d")


def parse_day_first(s, formats=("d.M.yyyy", "d.M.yy", "d/M/yyyy", "yyyy-MM-dd")) -> Column:
    """first format that parses (try_to_date never raises under ANSI)."""
    s = F.col(s) if isinstance(s, str) else s
    return F.coalesce(*[F.try_to_date(s, f) for f in formats])


def split_dates(s, seps=r"\s*(?:,|;|\+|&|und)\s*") -> Column:
    """split a multi-date cell on any separator."""
    s = F.col(s) if isinstance(s, str) else s
    return F.split(s, seps)


def date_context(day, days: int = 7) -> Column:
    """text listing day-7 .. day+7 with weekday names, one per line."""
    day = F.col(day) if isinstance(day, str) else day
    seq = F.sequence(F.date_sub(day, days), F.date_add(day, days))
    return F.array_join(F.transform(seq, lambda x: F.concat(F.date_format(x, "yyyy-MM-dd"), F.lit(" "),
                                                             F.date_format(x, "EEEE"))), "\n")


def day_line(region, day, holiday) -> Column:
    """Region, weekday, day and month in words and, if there is one, the holiday."""
    region, day, holiday = (F.col(c) if isinstance(c, str) else c for c in (region, day, holiday))
    date = F.concat(F.date_format(day, "EEEE"), F.lit(", "), F.dayofmonth(day).cast("string"), F.lit(". "),
                    F.date_format(day, "MMMM"), F.lit(" "), F.year(day).cast("string"))
    return F.concat(region, F.lit(", "), date, F.coalesce(F.concat(F.lit(", "), holiday), F.lit("")))


def any_of(*conds) -> Column:
    return reduce(lambda a, b: a | b, conds)
