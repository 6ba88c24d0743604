"""Date parsing for the renderings found on listing pages and in captions."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, functions as F

from eventloom.functions.text import SPACE, WORD, strip
from eventloom.schemas import (
    DUTCH_ABBREVIATIONS,
    DUTCH_MONTHS,
    ENGLISH_ABBREVIATIONS,
    ENGLISH_MONTHS,
)

_S, _W = f"[{SPACE}]", f"[{WORD}]"

# Fixed patterns. `d` lets `.` run over everything but a newline, `i` ignores case.
ISO_PREFIX = r"^\d{4}-\d{2}-\d{2}"
MONTH_DAY_YEAR = rf"(?id)^.*,?{_S}+({_W}{{3,9}}){_S}+(\d{{1,2}}),?{_S}+(\d{{4}})"
LEADING_MONTH_DAY = rf"(?i)^({_W}{{3,9}}){_S}+(\d{{1,2}})(?:th|st|nd|rd)?{_S}+(\d{{4}})?"
DAY_MONTH = rf"(?i)^{_W}{{2,3}}[.,]?{_S}+(\d{{1,2}}){_S}+({_W}{{3,9}})\.?{_S}+(\d{{4}})?"
MONTH_DAY = rf"(?id)^.*,?{_S}+({_W}{{3,9}}){_S}+(\d{{1,2}})"
BARE_MONTH_DAY = rf"(?i)^({_W}{{3,9}}){_S}+(\d{{1,2}})(?:th|st|nd|rd)?(?:,{_S}*(\d{{4}}))?$"


def _lookup(months: dict[str, int], name: Column) -> Column:
    pairs = [F.lit(x) for kv in months.items() for x in kv]
    return F.create_map(*pairs)[F.lower(name)]


def _date(year: Column, month: Column, day: Column) -> Column:
    # A day that does not exist gives NULL instead of failing the job.
    return F.format_string("%s-%02d-%02d", year, month, day.cast("int")).try_cast("date")


def parse_any_date(c: Column, ref_date: datetime.date | Column, relaxed: bool = False) -> Column:
    """First matching rendering wins; renderings without a year take the year of `ref_date`.

    `relaxed` also accepts a bare `Oct 30th` or `Oct 30, 2025`.
    """
    # As a function of one text, Spark takes the steps one by one. As a single expression they become one method of
    # generated code, too large to be compiled, in which every step costs many times as much.
    return F.get(F.transform(F.array(strip(c)), lambda s: _parsed(s, ref_date, relaxed)), 0)


def _parsed(s: Column, ref_date: datetime.date | Column, relaxed: bool) -> Column:
    ref_year = F.year(F.lit(ref_date)).cast("string")

    def part(pattern, i):
        return F.regexp_extract(s, pattern, i)

    def year(pattern):
        return F.coalesce(F.nullif(part(pattern, 3), F.lit("")), ref_year)

    iso = part(ISO_PREFIX, 0)
    with_year = _lookup(ENGLISH_ABBREVIATIONS, F.substring(part(MONTH_DAY_YEAR, 1), 1, 3))
    leading = _lookup(ENGLISH_MONTHS | ENGLISH_ABBREVIATIONS, part(LEADING_MONTH_DAY, 1))
    dutch = _lookup(DUTCH_MONTHS | DUTCH_ABBREVIATIONS, part(DAY_MONTH, 2))
    no_year = _lookup(ENGLISH_ABBREVIATIONS, F.substring(part(MONTH_DAY, 1), 1, 3))

    out = (
        F.when(iso != "", iso.try_cast("date"))
        .when(with_year.isNotNull(), _date(part(MONTH_DAY_YEAR, 3), with_year, part(MONTH_DAY_YEAR, 2)))
        .when(leading.isNotNull(), _date(year(LEADING_MONTH_DAY), leading, part(LEADING_MONTH_DAY, 2)))
        .when(dutch.isNotNull(), _date(year(DAY_MONTH), dutch, part(DAY_MONTH, 1)))
        .when(no_year.isNotNull(), _date(ref_year, no_year, part(MONTH_DAY, 2)))
    )
    if relaxed:
        bare = _lookup(ENGLISH_MONTHS | ENGLISH_ABBREVIATIONS, part(BARE_MONTH_DAY, 1))
        out = out.when(bare.isNotNull(), _date(year(BARE_MONTH_DAY), bare, part(BARE_MONTH_DAY, 2)))
    return out


def written_date(c: Column) -> Column:
    """Date in the first ten characters, as written; no time-zone shift.

    These must be four, two and two digits with dashes; anything else is NULL.
    """
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))
