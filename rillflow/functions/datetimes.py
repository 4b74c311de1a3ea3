"""Datetimes and time spans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.lexer import TICKS, QueryError
from ..plans import typed as ty
from ..plans.expr import shift
from ..plans.typed import Typed
from .registry import function, long, string

DAY = TICKS["d"]


def moment(col: Column) -> Typed:
    return Typed(col, "datetime")


def span(col: Column) -> Typed:
    return Typed(col.cast("bigint"), "timespan")


@function("now")
def now():
    return moment(F.current_timestamp())


@function("ago")
def ago(x):
    return moment(shift(F.current_timestamp(), -ty.as_span(x)))


@function("datetime", "todatetime", "make_datetime")
def todatetime(x):
    return moment(ty.as_datetime(x))


@function("bin", "floor")
def bin_(x, width):
    """Whole numbers are cut toward zero; reals by floor."""
    if x.type == "datetime":
        w = ty._div(ty.as_span(width) if width.type != "real" else ty.as_long(width), 10)
        return moment(F.timestamp_micros(ty._div(ty.micros(x.col), w) * w))
    if x.type == "real" or width.type == "real":
        v, w = ty.as_real(x), ty.as_real(width)
        return Typed(F.floor(v / F.when(w != 0, w)) * w, "real")
    v, w = ty.as_long(x), ty.as_long(width)
    return Typed(ty._div(v, w) * w, "timespan" if x.type == "timespan" else "long")


@function("datetime_diff")
def datetime_diff(part, a, b):
    x, y, p = ty.as_datetime(a), ty.as_datetime(b), str(part.value).lower()
    if p == "year":
        return long(F.year(x) - F.year(y))
    if p == "month":
        return long((F.year(x) - F.year(y)) * 12 + F.month(x) - F.month(y))
    units = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1000, "microsecond": 1}
    if p not in units:
        raise QueryError(f"datetime_diff: unknown part {p}")
    return long(ty._div(ty.micros(x) - ty.micros(y), units[p]))


def _week(col: Column) -> Column:
    return F.date_trunc("DAY", col) - F.make_dt_interval(F.dayofweek(col) - 1)


def _before(col: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(col) - 1)


for _name, _start, _next in (
    ("day", lambda c: F.date_trunc("DAY", c), lambda c: F.date_trunc("DAY", c) + F.expr("INTERVAL 1 DAY")),
    ("week", _week, lambda c: _week(c) + F.expr("INTERVAL 7 DAY")),
    ("month", lambda c: F.date_trunc("MONTH", c), lambda c: F.date_trunc("MONTH", c) + F.expr("INTERVAL 1 MONTH")),
    ("year", lambda c: F.date_trunc("YEAR", c), lambda c: F.date_trunc("YEAR", c) + F.expr("INTERVAL 1 YEAR")),
):
    function("startof" + _name)(lambda x, f=_start: moment(f(ty.as_datetime(x))))
    function("endof" + _name)(lambda x, f=_next: moment(_before(f(ty.as_datetime(x)))))

for _names, _f in ((("dayofmonth",), F.dayofmonth), (("getmonth", "monthofyear"), F.month), (("getyear",), F.year), (("hourofday",), F.hour), (("dayofyear",), F.dayofyear), (("weekofyear", "week_of_year"), F.weekofyear)):
    function(*_names)(lambda x, f=_f: long(f(ty.as_datetime(x))))


@function("dayofweek")
def dayofweek(x):
    return span((F.dayofweek(ty.as_datetime(x)) - 1).cast("bigint") * DAY)


@function("unixtime_seconds_todatetime")
def unixtime_seconds(x):
    return moment(F.timestamp_micros((ty.as_real(x) * 1_000_000).cast("bigint")))


@function("unixtime_milliseconds_todatetime")
def unixtime_milliseconds(x):
    return moment(F.timestamp_micros((ty.as_real(x) * 1000).cast("bigint")))


@function("datetime_add")
def datetime_add(part, n, x):
    d, k, p = ty.as_datetime(x), ty.as_long(n), str(part.value).lower()
    if p in ("year", "quarter", "month"):
        # A day beyond the month's end runs into the next month.
        months = k * {"year": 12, "quarter": 3, "month": 1}[p]
        first = F.date_trunc("MONTH", d)
        moved = F.add_months(first.cast("date"), months.cast("int")).cast("timestamp")
        return moment(F.timestamp_micros(F.unix_micros(moved) + F.unix_micros(d) - F.unix_micros(first)))
    units = {"week": 7 * DAY, "day": DAY, "hour": TICKS["h"], "minute": TICKS["m"], "second": TICKS["s"], "millisecond": TICKS["ms"], "microsecond": 10}
    if p not in units:
        raise QueryError(f"datetime_add: unknown part {p}")
    return moment(shift(d, k * units[p]))


@function("totimespan")
def totimespan(x):
    return span(ty.as_span(x))


@function("make_timespan")
def make_timespan(*xs):
    v = [ty.as_long(x) for x in xs]
    if len(v) == 2:
        v = [F.lit(0), *v, F.lit(0)]
    elif len(v) == 3:
        v = [F.lit(0), *v]
    elif len(v) != 4:
        raise QueryError("make_timespan takes 2 to 4 arguments")
    return span(((v[0] * 24 + v[1]) * 60 + v[2]) * 600_000_000 + v[3] * 10_000_000)


def _two(col: Column, n: int = 2) -> Column:
    return F.lpad(col.cast("string"), n, "0")


@function("format_datetime")
def format_datetime(x, form):
    """A literal format of runs of y M d H h m s f F and tt; anything else stands for itself."""
    d = ty.as_datetime(x)
    frac = _two(F.pmod(F.unix_micros(d), F.lit(1_000_000)), 6)
    hour12 = F.pmod(F.hour(d) + 11, F.lit(12)) + 1
    parts: list[Column] = []
    for m in re.finditer(r"y+|M+|d+|H+|h+|m+|s+|f+|F+|tt|.", str(form.value), re.S):
        run, c, n = m.group(), m.group()[0], len(m.group())
        plain = {"M": F.month(d), "d": F.dayofmonth(d), "H": F.hour(d), "h": hour12, "m": F.minute(d), "s": F.second(d)}
        if c == "y" and n in (1, 2, 4):
            year = F.year(d)
            parts.append(_two(year, 4) if n == 4 else _two(F.pmod(year, F.lit(100))) if n == 2 else F.pmod(year, F.lit(100)).cast("string"))
        elif c in plain and n in (1, 2):
            parts.append(_two(plain[c]) if n == 2 else plain[c].cast("string"))
        elif c in "fF" and n <= 7:
            cut = F.substring(F.concat(frac, F.lit("0")), 1, n)
            parts.append(cut if c == "f" else F.rtrim(cut, F.lit("0")))
        elif run == "tt":
            parts.append(F.when(F.hour(d) < 12, "AM").otherwise("PM"))
        else:
            parts.append(F.lit(run))
    return string(F.concat(*parts) if parts else F.lit(""))


@function("format_timespan")
def format_timespan(x, form=None):
    ticks = ty.as_span(x)
    a = F.abs(ticks)
    day, hour, minute, second, frac = ty._div(a, DAY), F.pmod(ty._div(a, TICKS["h"]), F.lit(24)), F.pmod(ty._div(a, TICKS["m"]), F.lit(60)), F.pmod(ty._div(a, TICKS["s"]), F.lit(60)), _two(F.pmod(a, F.lit(TICKS["s"])), 7)
    parts: list[Column] = []
    for m in re.finditer(r"d+|H+|h+|m+|s+|f+|F+|.", str(form.value) if form is not None else "d.hh:mm:ss.fffffff", re.S):
        run, c, n = m.group(), m.group()[0], len(m.group())
        plain = {"d": day, "H": hour, "h": hour, "m": minute, "s": second}
        if c in plain and n <= (8 if c == "d" else 2):
            parts.append(_two(plain[c], n) if n > 1 else plain[c].cast("string"))
        elif c in "fF" and n <= 7:
            parts.append(F.substring(frac, 1, n) if c == "f" else F.rtrim(F.substring(frac, 1, n), F.lit("0")))
        else:
            parts.append(F.lit(run))
    return string(F.concat(F.when(ticks < 0, "-").otherwise(""), *parts))
