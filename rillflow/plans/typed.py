"""Typed columns: a Spark Column with the query language's type.

string, guid    string            bool       boolean
int, long       bigint            datetime   timestamp, UTC
real            double            timespan   bigint, ticks of 100 ns
dynamic         string, JSON text
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..lang.lexer import TICKS, QueryError

SPARK = {"string": "string", "guid": "string", "long": "bigint", "int": "bigint", "real": "double", "bool": "boolean", "datetime": "timestamp", "timespan": "bigint", "dynamic": "string", "null": "string"}
NUMERIC = ("int", "long", "real")


@dataclass(frozen=True)
class Typed:
    col: Column
    type: str
    value: object = None  # of a literal
    const: bool = False
    #: Of JSON text that was just made, what it was made from, so that nobody need parse it:
    jsons: Column | None = None  # an array's elements as JSON texts
    nums: Column | None = None  # an array's elements as reals, where all are finite numbers or null
    num: Column | None = None  # a single number
    size: int | None = None  # of nums, where all rows have the same


def literal(value, kind: str) -> Typed:
    col = F.lit(value).cast(SPARK[kind])
    return Typed(col, kind, value, True)


def type_of(kind: S.DataType) -> str:
    if isinstance(kind, (S.LongType, S.IntegerType, S.ShortType, S.ByteType)):
        return "long"
    if isinstance(kind, (S.DoubleType, S.FloatType, S.DecimalType)):
        return "real"
    if isinstance(kind, S.BooleanType):
        return "bool"
    if isinstance(kind, (S.TimestampType, S.TimestampNTZType, S.DateType)):
        return "datetime"
    if isinstance(kind, (S.ArrayType, S.MapType, S.StructType, S.VariantType)):
        return "dynamic"
    return "string"


def parse_datetime(text: str) -> datetime | None:
    text = text.strip()
    if text == "null":
        return None
    m = re.fullmatch(r"(\d{4})-(\d\d?)(?:-(\d\d?))?(?:[T ](\d\d?):(\d\d)(?::(\d\d)(?:\.(\d{1,9}))?)?)?\s*(Z|[+-]\d\d:?\d\d)?", text)
    if not m:
        raise QueryError(f"not a datetime: {text}")
    y, mo, d, h, mi, s, f, zone = m.groups()
    out = datetime(int(y), int(mo), int(d or 1), int(h or 0), int(mi or 0), int(s or 0), int((f or "0").ljust(6, "0")[:6]), timezone.utc)
    if zone and zone != "Z":
        from datetime import timedelta

        shift = timedelta(hours=int(zone[1:3]), minutes=int(zone[-2:]))
        out -= shift if zone[0] == "+" else -shift
    return out


def parse_timespan(text: str) -> int | None:
    text = text.strip()
    if text == "null":
        return None
    if m := re.fullmatch(r"(-?)(?:(\d+)\.)?(\d+):(\d\d)(?::(\d\d)(?:\.(\d{1,7}))?)?", text):
        sign, d, h, mi, s, f = m.groups()
        ticks = ((int(d or 0) * 24 + int(h)) * 60 + int(mi)) * 60 + int(s or 0)
        return (-1 if sign else 1) * (ticks * 10_000_000 + int((f or "0").ljust(7, "0")))
    if m := re.fullmatch(r"(-?\d+(?:\.\d+)?)([a-z]+)", text):
        if m.group(2) in TICKS:
            return round(float(m.group(1)) * TICKS[m.group(2)])
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    raise QueryError(f"not a timespan: {text}")


def raw_literal(text: str, kind: str) -> Typed:
    """datetime(...), timespan(...), guid(...) and dynamic(...) literals."""
    if kind == "datetime":
        value = parse_datetime(text)
        return Typed(F.timestamp_micros(F.lit(None if value is None else round((value - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)).cast("bigint")), kind, value, True)
    if kind == "timespan":
        return literal(parse_timespan(text), kind)
    if kind == "guid":
        return literal(None if text == "null" else text, kind)
    try:
        value = json.loads(text)
    except ValueError:
        value = json.loads(re.sub(r"'([^'\"]*)'", r'"\1"', text))
    jsons = nums = None
    if isinstance(value, list) and value and all(v is None or type(v) in (int, float) and abs(v) < 1e15 and "e" not in repr(v) for v in value):
        jsons, nums = F.array(*[F.lit(canonical(v)) for v in value]), F.array(*[F.lit(None if v is None else float(v)).cast("double") for v in value])
    return Typed(F.lit(None if value is None else canonical(value)).cast("string"), "dynamic", value, True, jsons, nums, size=len(value) if nums is not None else None)


def canonical(value) -> str:
    """JSON text with sorted keys and whole reals as integers."""

    def plain(x):
        if isinstance(x, dict):
            return {k: plain(x[k]) for k in sorted(x)}
        if isinstance(x, list):
            return [plain(v) for v in x]
        return int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 1e15 else x

    return json.dumps(plain(value), separators=(",", ":"), ensure_ascii=False)


# -- casts


def real_text(col: Column) -> Column:
    """Whole reals without a fraction, others as Spark writes them."""
    whole = (col == F.floor(col)) & (F.abs(col) < 1e15)
    return F.when(whole, col.cast("bigint").cast("string")).otherwise(col.cast("string"))


def span_text(ticks: Column) -> Column:
    """[-][d.]hh:mm:ss[.fffffff]"""
    a = F.abs(ticks)
    part = lambda unit, of: F.lpad(F.pmod(_div(a, unit), F.lit(of)).cast("string"), 2, "0")
    day, frac = _div(a, TICKS["d"]), F.pmod(a, F.lit(TICKS["s"]))
    return F.concat(F.when(ticks < 0, "-").otherwise(""), F.when(day > 0, F.concat(day.cast("string"), F.lit("."))).otherwise(""), part(TICKS["h"], 24), F.lit(":"), part(TICKS["m"], 60), F.lit(":"), part(TICKS["s"], 60), F.when(frac > 0, F.concat(F.lit("."), F.rtrim(F.lpad(frac.cast("string"), 7, "0"), F.lit("0")))).otherwise(""))


def _div(a: Column, b) -> Column:
    """Whole division, toward zero; by zero null."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.call_function("div", a, F.when(b != 0, b))


def micros(col: Column) -> Column:
    return F.unix_micros(col)


def datetime_text(col: Column) -> Column:
    frac = F.pmod(micros(col), F.lit(1_000_000))
    return F.concat(F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"), F.when(frac > 0, F.concat(F.lit("."), F.rtrim(F.lpad(frac.cast("string"), 6, "0"), F.lit("0")))).otherwise(""), F.lit("Z"))


def text(x: Typed) -> Column:
    """The value as text; null stays null."""
    if x.type == "real":
        return real_text(x.col)
    if x.type == "datetime":
        return datetime_text(x.col)
    if x.type == "timespan":
        return span_text(x.col)
    if x.type == "dynamic":
        # A JSON string shows without its quotes.
        return F.when(F.substring(F.ltrim(x.col), 1, 1) == '"', F.try_variant_get(F.try_parse_json(x.col), "$", "string")).otherwise(x.col)
    return x.col.cast("string")


def json_string(col: Column) -> Column:
    """A text as a JSON string: the quotes stay when the brackets of an array of it go."""
    return F.btrim(F.to_json(F.array(col)), F.lit("[]"))


def as_json(x: Typed) -> Column:
    """JSON text of a value; null as JSON null."""
    if x.type == "dynamic":
        out = x.col
    elif x.type in ("string", "guid", "datetime", "timespan"):
        out = json_string(text(x))
    else:
        out = text(x)
    return F.coalesce(out, F.lit("null"))


def as_real(x: Typed) -> Column:
    if x.type == "dynamic":
        return F.try_variant_get(F.try_parse_json(x.col), "$", "double") if x.num is None else x.num
    if x.type == "datetime":
        return micros(x.col).cast("double") * 1000
    if x.type in ("string", "guid", "null"):
        return x.col.try_cast("double")
    return x.col.cast("double")


def as_long(x: Typed) -> Column:
    if x.type in ("long", "int", "timespan", "bool"):
        return x.col.cast("bigint")
    if x.type == "real":
        return x.col.try_cast("bigint")
    if x.type == "datetime":
        return micros(x.col) * 1000
    if x.type == "dynamic":
        return as_real(x).try_cast("bigint")
    return F.coalesce(x.col.try_cast("bigint"), x.col.try_cast("double").try_cast("bigint"))


def as_datetime(x: Typed) -> Column:
    if x.type == "datetime":
        return x.col
    if x.type in ("long", "int"):
        return F.timestamp_micros(_div(x.col, 1000))
    return F.try_to_timestamp(text(x))


def as_span(x: Typed) -> Column:
    if x.type in ("timespan", "long", "int"):
        return x.col.cast("bigint")
    if x.type == "real":
        return x.col.try_cast("bigint")
    s = F.trim(text(x))
    clock = r"^(-?)(?:(\d+)\.)?(\d+):(\d\d)(?::(\d\d)(?:\.(\d{1,7}))?)?$"
    g = lambda k: F.coalesce(F.regexp_extract(s, clock, k).try_cast("bigint"), F.lit(0))
    ticks = (((g(2) * 24 + g(3)) * 60 + g(4)) * 60 + g(5)) * 10_000_000 + F.coalesce(F.rpad(F.regexp_extract(s, clock, 6), 7, "0").try_cast("bigint"), F.lit(0))
    ticks = F.when(F.regexp_extract(s, clock, 1) == "-", -ticks).otherwise(ticks)
    unit = r"^(-?\d+(?:\.\d+)?)(d|h|min|m|s|ms|us|tick)$"
    scale = F.lit(None).cast("bigint")
    for name, n in TICKS.items():
        scale = F.when(F.regexp_extract(s, unit, 2) == name, F.lit(n)).otherwise(scale)
    return F.when(s.rlike(clock), ticks).when(s.rlike(unit), F.round(F.regexp_extract(s, unit, 1).try_cast("double") * scale).cast("bigint")).otherwise(s.try_cast("bigint"))


def cast(x: Typed, kind: str) -> Typed:
    if x.type == kind:
        return x
    if x.type == "null":
        return Typed(F.lit(None).cast(SPARK[kind]), kind)
    how: dict[str, Callable[[Typed], Column]] = {"string": text, "guid": text, "real": as_real, "long": as_long, "int": as_long, "datetime": as_datetime, "timespan": as_span}
    if kind in how:
        return Typed(how[kind](x), kind)
    if kind == "bool":
        if x.type in NUMERIC:
            return Typed(x.col != 0, kind)
        low = F.lower(text(x))
        return Typed(F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False), kind)
    if kind == "dynamic":
        return Typed(F.when(x.col.isNotNull(), as_json(x)), kind)
    raise QueryError(f"no cast from {x.type} to {kind}")


def common(kinds: list[str]) -> str:
    """The type that holds values of all of these."""
    left = [k for k in kinds if k != "null"]
    if not left:
        return "string"
    if len(set(left)) == 1:
        return left[0]
    if all(k in NUMERIC for k in left):
        return "real" if "real" in left else "long"
    if "dynamic" in left:
        return "dynamic"
    return "string" if "string" in left or "guid" in left else left[0]
