"""Calendars as whole-number arithmetic on day numbers (day 1 is 1 January of the year 1); all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# The first day of the Hebrew calendar's year 1, the mean length of its year in days, the parts of a day.
EPOCH, MEAN_YEAR, PARTS = -1373427, 365.2468, 25920
#: A cycle of daily study: its first day (5 January 2020) and its pages.
STUDY_START, STUDY_PAGES = 737429, 2711


def _div(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("long")


def elapsed(year: Column) -> Column:
    """Days from the epoch to the mean new moon of a year's first month, moved where it would fall on a Sunday, Wednesday or Friday."""
    months = _div(235 * year - 234, 19)
    day = 29 * months + _div(12084 + 13753 * months, PARTS)
    return let(day, lambda d: F.when((3 * (d + 1)) % 7 < 3, d + 1).otherwise(d))


def new_year(year: Column) -> Column:
    """The day number of a Hebrew year's first day; moved so that no year has 356 or 382 days."""

    def moved(d: Column) -> Column:
        before, own, after = F.get(d, F.lit(0)), F.get(d, F.lit(1)), F.get(d, F.lit(2))
        return EPOCH + own + F.when(after - own == 356, 2).when(own - before == 382, 1).otherwise(0)

    return let(F.array(elapsed(year - 1), elapsed(year), elapsed(year + 1)), moved)


def _year_then(day: Column, then: Callable[[Column], Column]) -> Column:
    guess = F.floor((day - EPOCH) / MEAN_YEAR).cast("long") + 1
    return let(let(guess, lambda y: F.when(new_year(y) > day, y - 1).when(new_year(y + 1) <= day, y + 1).otherwise(y)), then)


def hebrew(day: Column) -> Column:
    """(year, day_of_year from 1, days of the year) in the Hebrew calendar."""
    return _year_then(day, lambda y: F.struct(y.alias("year"), (day - new_year(y) + 1).alias("day_of_year"), (new_year(y + 1) - new_year(y)).alias("days")))


def study_page(day: Column) -> Column:
    """(cycle from 0, page from 0) of a day of study; before the first day, null."""
    since = day - STUDY_START
    return F.when(since >= 0, F.struct(_div(since, STUDY_PAGES).alias("cycle"), (since % STUDY_PAGES).alias("page")))


def folio(page: Column) -> Column:
    """The address of a page, counted from 0, in a work whose leaves begin at 2 and have two sides: 2a, 2b, 3a ..."""
    return F.concat((_div(page, 2) + 2).cast("string"), F.when(page % 2 == 0, "a").otherwise("b"))


def page_of(folio: Column) -> Column:
    """The inverse of ``folio``; null for what is no such address."""
    leaf = F.regexp_extract(folio, r"^(\d+)[ab]$", 1)
    return F.when(leaf != "", (F.try_to_number(leaf, F.lit("9" * 18)).cast("long") - 2) * 2 + F.when(F.right(folio, F.lit(1)) == "b", 1).otherwise(0))


def years(text: Column) -> Column:
    """(y0, y1) of a written date: '1040', '1040-1105', 'c. 12th century', either with BCE or BC (negative); else null."""
    n = lambda i: F.regexp_extract(text, r"(?i)^\s*(?:c\.?\s*|ca\.?\s*)?(\d{1,4})(?:\s*[-–]\s*(\d{1,4}))?\s*(bce?|ce|ad)?\s*$", i)
    cent = F.regexp_extract(text, r"(?i)^\s*(?:c\.?\s*|ca\.?\s*)?(\d{1,2})(?:st|nd|rd|th)\s+century\s*(bce?|ce|ad)?\s*$", 1)
    before = F.lower(text).rlike(r"bce?\s*$")
    a, b = n(1).try_cast("int"), F.coalesce(n(2).try_cast("int"), n(1).try_cast("int"))
    c = cent.try_cast("int")
    plain = F.when(before, F.struct(-a, -b)).otherwise(F.struct(a, b))
    century = F.when(before, F.struct(-c * 100, -(c * 100 - 99))).otherwise(F.struct((c - 1) * 100 + 1, c * 100))
    return F.when(n(1) != "", plain).when(cent != "", century).cast("struct<y0:int,y1:int>")
