"""Dates and times."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import types as t
from tessera.expr import Expr, mapped, unary


def _part(name, function, date_too=True):
    def made(e) -> Expr:
        def make(x, k):
            if not (k in (t.DATE, t.TIME) if date_too else k == t.TIME) and k != t.VOID:
                raise TypeError(f"{name} takes {'dates and ' * date_too}times")
            return function(x).cast("int"), t.INT32

        return unary(e, name, make)

    made.__name__ = name
    return made


year, month, day = _part("year", F.year), _part("month", F.month), _part("day", F.day)
day_of_week = _part("day_of_week", lambda x: F.weekday(x) + 1)
hour, minute, second = (_part(n, getattr(F, n), False) for n in ("hour", "minute", "second"))
nanosecond = _part("nanosecond", lambda x: F.pmod(F.unix_micros(x.cast("timestamp_ltz")), F.lit(1000000)) * 1000, False)


def _whole(p, names):
    for q, n in zip(p, names, strict=False):
        if not (t.is_int(q.type) or q.type == t.VOID):
            raise TypeError(f"{n} takes whole numbers")


def _date(y, m, d):
    """NA for a day that is not in the calendar."""
    month = F.when((m >= 1) & (m <= 12) & (y >= 1) & (y <= 9999), F.make_date(F.when((y >= 1) & (y <= 9999), y), F.when((m >= 1) & (m <= 12), m), F.lit(1)))
    return F.when((d >= 1) & (d <= F.day(F.last_day(month))), F.date_add(month, d - 1))


def ymd(year, month, day) -> Expr:
    def make(p):
        _whole(p, ("year", "month", "day"))
        return _date(*(q.column.cast("int") for q in p)), t.DATE

    return mapped([year, month, day], make, "ymd")


def ymdt(year=None, month=None, day=None, hour=0, minute=0, second=0, nanosecond=0, *, date=None) -> Expr:
    """A time of its parts, or of a date and the time of day; nanoseconds are kept to the microsecond."""

    def at(day_, h, m, s, ns):
        micros = ((h.cast("bigint") * 60 + m) * 60 + s) * 1000000 + F.floor(ns / 1000)
        return F.when(micros.isNotNull() & day_.isNotNull(), day_.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), micros.cast("decimal(20,0)") / 1000000))

    if date is not None:
        def make(p):
            if p[0].type != t.DATE:
                raise TypeError("date takes dates")
            return at(p[0].column, *(q.column for q in p[1:])), t.TIME

        return mapped([date, hour, minute, second, nanosecond], make, "ymdt")

    def make(p):
        _whole(p, ("year", "month", "day", "hour", "minute", "second", "nanosecond"))
        return at(_date(*(q.column.cast("int") for q in p[:3])), *(q.column for q in p[3:])), t.TIME

    return mapped([year, month, day, hour, minute, second, nanosecond], make, "ymdt")
