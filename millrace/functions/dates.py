"""Date and time functions as Column expressions.

Month arithmetic is that of the calendar; year carries and borrows are right at every December and January.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MissingArgumentError

# Microseconds of each unit.
MICROSECONDS = {"us": 1, "ms": 1_000, "s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "day": 86_400_000_000}
# The formats tried, in this order; the first that fits wins.
FORMATS = (
    "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y-%m", "%Y/%m", "%Y.%m", "%Y", "%y-%m-%d", "%y/%m/%d", "%y.%m.%d",
    "%b %d, %Y", "%B %d, %Y", "%B %d %Y", "%m/%d/%Y", "%m/%d/%y", "%b %Y", " %B%Y", "%b %d,%Y",
)
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_LETTERS = "".join(m[:3] for m in MONTHS)
# What each part of a format stands for; a space is any white space, and there is no year 0.
_PARTS = {
    "%Y": r"(?!0000)(\d{4})", "%y": r"(\d{2})", "%m": r"(1[0-2]|0[1-9]|[1-9])", "%d": r"(3[01]|[12]\d|0[1-9]|[1-9]| [1-9])",
    "%b": "(" + "|".join(m[:3] for m in MONTHS) + ")", "%B": "(" + "|".join(MONTHS) + ")",
}


def add_days(d: Column, n: Column | int) -> Column:
    return F.date_add(d, n)


def add_weeks(d: Column, n: int) -> Column:
    return F.date_add(d, 7 * n)


def add_months(d: Column, n: int, round: str = "down") -> Column:
    """Down: clip to the month's end. Anything else: on to the first of the next month."""
    clipped = F.add_months(d, n)
    return clipped if round == "down" else F.when(F.day(clipped) < F.day(d), F.date_add(clipped, 1)).otherwise(clipped)


def add_quarters(d: Column, n: int, round: str = "down") -> Column:
    return add_months(d, 3 * n, round)


def add_years(d: Column, n: int, round: str = "down") -> Column:
    return add_months(d, 12 * n, round)


def add_time(d: Column, n: int, unit: str, round: str = "down") -> Column:
    """By day, week, month, quarter or year, singular or plural; an unknown unit changes nothing."""
    unit = unit.lower().rstrip("s")
    if unit in ("day", "week"):
        return F.date_add(d, n * (7 if unit == "week" else 1))
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    return d if months is None else add_months(d, n * months, round)


def string_to_date(s: Column) -> Column:
    """Characters 1-4, 6-7 and 9-10, whatever stands between."""
    part = lambda at, n: F.substring(s, at, n).cast("int")
    return F.make_date(part(1, 4), part(6, 2), part(9, 2))


def _parsed(s: Column, fmt: str) -> Column:
    """The date that ``fmt`` finds in the whole of ``s``, else null; a missing month or day is the first.

    A text without the format's punctuation is not matched at all, any other once, and each part of one that fits is
    taken once: the expression is small, however often it is used."""
    pieces = re.split("(%.)", fmt)
    pattern = "(?i)^" + "".join(_PARTS.get(x) or re.sub(r"\s+", r"\\s+", re.escape(x).replace("\\ ", " ")) for x in pieces) + "$"
    part = {x: F.regexp_extract(s, pattern, n) for n, x in enumerate((x for x in pieces if x in _PARTS), 1)}
    fits = s.rlike(pattern)
    for mark in sorted(set("".join(x for x in pieces if x not in _PARTS)) - {" "}):
        fits = s.contains(mark) & fits
    year = part["%Y"] if "%Y" in part else (F.pmod(part["%y"].try_cast("int") - 69, F.lit(100)) + 1969).cast("string")
    month, day = F.lit("01"), F.lit("01")
    if "%m" in part:
        month = F.lpad(part["%m"], 2, "0")
    elif "%b" in part or "%B" in part:
        letters = F.lower(F.substring(part["%b" if "%b" in part else "%B"], 1, 3))
        month = F.lpad(((F.instr(F.lit(_LETTERS), letters) + 2) / 3).cast("int").cast("string"), 2, "0")
    if "%d" in part:
        day = F.lpad(F.trim(part["%d"]), 2, "0")
    return F.when(fits, F.concat(year, F.lit("-"), month, F.lit("-"), day).try_cast("date"))


def parse_date(s: Column, fmt: str | None = None) -> Column:
    """The date by the first of ``FORMATS`` that fits the whole text, else null; or by ``fmt`` alone, of the same
    parts (%Y, %y, %m, %d, %b, %B). Names of months in any case; two-digit years are 1969 to 2068.

    The formats stand inside a function of the text: unrolled into generated code they make a method that the JVM does
    not compile, and ``s`` would be computed for each of their parts."""
    return F.transform(F.array(s), lambda x: F.coalesce(*[_parsed(x, f) for f in ([fmt] if fmt else FORMATS)]))[0]


def year_month(d: Column) -> Column:
    """yyyymm."""
    return F.year(d) * 100 + F.month(d)


def year_quarter(d: Column) -> Column:
    return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))


def year_quarter_int(d: Column) -> Column:
    """yyyyq, the form that is parsed too."""
    return F.year(d) * 10 + F.quarter(d)


def month_index(d: Column) -> Column:
    """Months since year 0."""
    return F.year(d) * 12 + F.month(d)


def date_part(d: Column, part: str, sep: str = "-", abr: bool = False) -> Column:
    """day, month, monthname, quarter, year, yearmonth, yearmonthabr, yearmonthname, yearquarter, weekday (Monday 0), weekdayname."""
    name = "MMM" if abr else "MMMM"
    parts = {
        "day": lambda: F.day(d),
        "month": lambda: F.month(d),
        "monthname": lambda: F.date_format(d, name),
        "quarter": lambda: F.quarter(d),
        "year": lambda: F.year(d),
        "yearmonth": lambda: F.date_format(d, f"yyyy'{sep}'MM"),
        "yearmonthabr": lambda: F.date_format(d, f"yyyy'{sep}'MMM"),
        "yearmonthname": lambda: F.date_format(d, f"yyyy'{sep}'MMMM"),
        "yearquarter": lambda: F.concat(F.year(d).cast("string"), F.lit(f"{sep}Q"), F.quarter(d).cast("string")),
        "weekday": lambda: F.weekday(d),
        "weekdayname": lambda: F.date_format(d, "EEE" if abr else "EEEE"),
    }
    if part not in parts:
        raise MissingArgumentError(f"unknown part {part}")
    return parts[part]()


def year_month_to_date(x: Column, day: int = 1) -> Column:
    """yyyymm to a date; a day past the month's end becomes its last day."""
    first = F.make_date((x / 100).cast("int"), (x % 100).cast("int"), F.lit(1))
    return F.least(F.date_add(first, day - 1), F.last_day(first))


def first_day_of_month(d: Column) -> Column:
    return F.trunc(d, "MM")


def last_day_of_month(d: Column) -> Column:
    return F.last_day(d)


def first_day_of_quarter(d: Column) -> Column:
    return F.trunc(d, "QUARTER")


def last_day_of_quarter(d: Column) -> Column:
    return F.last_day(F.add_months(F.trunc(d, "QUARTER"), 2))


def month_name(n: Column, abr: bool = False) -> Column:
    return F.date_format(F.make_date(F.lit(2000), n, F.lit(1)), "MMM" if abr else "MMMM")


def month_number(name: Column) -> Column:
    """By the first three letters, in any case; null for other words."""
    at = F.instr(F.lit(_LETTERS), F.lower(F.substring(name, 1, 3)))
    return F.when((F.length(name) >= 3) & (at % 3 == 1), ((at + 2) / 3).cast("int"))


def number_of_days(year: Column, month: Column | None = None) -> Column:
    if month is None:
        return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return F.day(F.last_day(F.make_date(year, month, F.lit(1))))


def quarter(d: Column) -> Column:
    return F.quarter(d)


def week_number(d: Column) -> Column:
    return F.weekofyear(d)


def today() -> Column:
    return F.current_date()


def today_string(fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.current_date(), fmt)


def make_date(year: Column | None = None, month: Column | None = None, day: Column | None = None) -> Column:
    """Parts that are not given, or null, are today's."""
    now = F.current_date()
    part = lambda x, f: f(now) if x is None else F.coalesce(x, f(now))
    return F.make_date(part(year, F.year), part(month, F.month), part(day, F.day))


def convert(microseconds: Column, unit: str) -> Column:
    if unit not in MICROSECONDS:
        raise MissingArgumentError(f"unknown unit {unit}")
    return microseconds / F.lit(float(MICROSECONDS[unit]))


def elapsed(start: Column, end: Column, unit: str = "s") -> Column:
    """Time between two timestamps, by microseconds; months and years by the calendar."""
    if unit == "month":
        return elapsed_months(start, end)
    if unit == "year":
        return elapsed_months(start, end) / 12
    return convert(F.timestamp_diff("MICROSECOND", start, end), unit)


def elapsed_months(start: Column, end: Column) -> Column:
    """Years times 12, plus months, plus days by 31."""
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start)) + (F.day(end) - F.day(start)) / 31


def best_unit(microseconds: Column) -> Column:
    ladder = F.when(microseconds < 1_000, "us").when(microseconds < 1_000_000, "ms").when(microseconds < 60_000_000, "s")
    return ladder.when(microseconds < 3_600_000_000, "min").when(microseconds < 86_400_000_000, "h").otherwise("day")


def parse_year_month(s: Column) -> Column:
    """yyyymm from '202103', '2021-03', '2021/3' or '2021 Mar'; null for other text."""
    s = s.cast("string")
    year = F.regexp_extract(s, r"^\s*(\d{4})", 1).try_cast("int")
    digits = F.regexp_extract(s, r"^\s*\d{4}\D?(\d{1,2})\s*$", 1).try_cast("int")
    month = F.coalesce(digits, month_number(F.regexp_extract(s, r"^\s*\d{4}\W*([A-Za-z]{3,})", 1)))
    return F.when(month.between(1, 12), year * 100 + month)


def parse_year_quarter(s: Column) -> Column:
    """yyyyq from '2021Q3', '2021-q3' or '20213'; null for other text."""
    s = s.cast("string")
    year = F.regexp_extract(s, r"^\s*(\d{4})", 1).try_cast("int")
    part = F.regexp_extract(s, r"^\s*\d{4}\W?[Qq]?([1-4])\s*$", 1).try_cast("int")
    return year * 10 + part


def add_year_months(ym: Column, n: int) -> Column:
    """yyyymm moved by months."""
    total = F.floor(ym / 100) * 12 + ym % 100 - 1 + n
    return (F.floor(total / 12) * 100 + F.pmod(total, F.lit(12)) + 1).cast("int")
