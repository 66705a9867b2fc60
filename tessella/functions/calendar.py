"""Calendars: day numbers of dates, and patterns that recur every year."""

from __future__ import annotations

import re

from tessella.functions.intervals import Interval, IntervalSet
from tessella.plans.syntax import QueryError


def gregorian_day(year: int, month: int, day: int) -> int:
    """The Julian day number of a date of the proleptic Gregorian calendar."""
    a = (14 - month) // 12
    y, m = year + 4800 - a, month + 12 * a - 3
    return day + (153 * m + 2) // 5 + 365 * y + y // 4 - y // 100 + y // 400 - 32045


def julian_day(year: int, month: int, day: int) -> int:
    a = (14 - month) // 12
    y, m = year + 4800 - a, month + 12 * a - 3
    return day + (153 * m + 2) // 5 + 365 * y + y // 4 - 32083


def leap(year: int, system: str = "gregorian") -> bool:
    return year % 4 == 0 and (system == "julian" or year % 100 != 0 or year % 400 == 0)


def month_days(year: int, month: int, system: str = "gregorian") -> int:
    return 29 if month == 2 and leap(year, system) else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[month - 1]


def day_number(text: str, system: str = "gregorian") -> int:
    m = re.fullmatch(r"(-?\d{1,6})-(\d{1,2})-(\d{1,2})", text)
    if not m:
        raise QueryError("GMQL4003", f"{text!r} is no date")
    y, mo, d = map(int, m.groups())
    if not 1 <= mo <= 12 or not 1 <= d <= month_days(y, mo, system):
        raise QueryError("GMQL4003", f"{text!r} is no date")
    return gregorian_day(y, mo, d) if system == "gregorian" else julian_day(y, mo, d)


def day_sql(date: str) -> str:
    """The day number of a DATE or TIMESTAMP expression."""
    return f"(datediff(CAST({date} AS DATE), DATE'1970-01-01') + 2440588)"


def week_one(year: int) -> int:
    """The Monday of the week with 4 January."""
    at = gregorian_day(year, 1, 4)
    return at - at % 7


def occurrences(month: int, day: int, first: int, last: int, system: str = "gregorian") -> list[int]:
    """The day numbers of a yearly date in the years from first to last; a 29 February only in leap years; 99 is the last.

    From month 20 on, 100 * month + day is 2000 + 10 * week + day of a week; a 53rd week only in the years that have one.
    """
    if month >= 20:
        week, at = divmod(100 * month + day - 2000, 10)
        return [week_one(y) + 7 * (week - 1) + at - 1 for y in range(first, last + 1) if week_one(y) + 7 * (week - 1) < week_one(y + 1)]
    number = gregorian_day if system == "gregorian" else julian_day
    each = ((y, month_days(y, month, system)) for y in range(first, last + 1))
    return [number(y, month, min(day, n)) for y, n in each if day <= n or day == 99]


def year_of(day: int) -> int:
    y = (day - 1721426) // 365 + 1
    while gregorian_day(y, 1, 1) > day:
        y -= 1
    return y


def recur(axis: str, start: tuple[int, int], end: tuple[int, int] | None, lo: int, hi: int) -> IntervalSet:
    """A yearly pattern within days [lo, hi): from each start through the first end within 371 days after it.

    Without an end each start is one day. Windows of 10 000 years and more are refused.
    """
    first, last = year_of(lo), year_of(max(lo, hi - 1))
    if last - first >= 10_000:
        raise QueryError("GMQL4005", "the window is too long")
    starts = occurrences(*start, first - 10, last + 10)
    ends = occurrences(*end, first - 10, last + 11) if end else starts
    out = []
    for s in starts:
        e = next((x for x in ends if s <= x <= s + 371), None) if end else s
        if e is not None and max(s, lo) < min(e + 1, hi):
            out.append(Interval.of(axis, max(s, lo), min(e + 1, hi), True, False))
    return IntervalSet(out)
