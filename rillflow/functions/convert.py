"""Conversions, conditions and arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lang.lexer import QueryError
from ..plans import typed as ty
from ..plans.typed import Typed, text
from .registry import boolean, function, lazy, long, real, string


@function("toint", "tolong", "int", "long")
def tolong(x):
    """Text that is no number gives 0; null stays null."""
    return long(F.coalesce(ty.as_long(x), F.when(x.col.isNotNull(), F.lit(0))))


@function("todouble", "toreal", "real", "double")
def toreal(x):
    return real(F.coalesce(ty.as_real(x), F.when(x.col.isNotNull(), F.lit(0.0))))


@function("tostring")
def tostring(x):
    return string(F.coalesce(text(x), F.lit("")))


@function("tobool", "toboolean", "bool")
def tobool(x):
    if x.type == "bool":
        return x
    if x.type in ty.NUMERIC:
        return boolean(x.col != 0)
    low = F.lower(text(x))
    return boolean(F.when(low.isin("true", "1"), True).when(low.isin("false", "0", ""), False))


@function("isnull")
def isnull(x):
    return boolean(x.col.isNull() | (F.coalesce(x.col, F.lit("")) == "null") if x.type == "dynamic" else x.col.isNull())


@function("isnotnull", "notnull")
def isnotnull(x):
    return boolean(~isnull(x).col)


@function("parse_json", "todynamic")
def parse_json(x):
    return Typed(x.col if x.type == "dynamic" else text(x), "dynamic", x.value, False)


@lazy("iff", "iif")
def iff(bind, e):
    a, b = bind(e.args[1]), bind(e.args[2])
    kind = ty.common([a.type, b.type])
    return Typed(F.when(F.coalesce(bind.predicate(e.args[0]), F.lit(False)), ty.cast(a, kind).col).otherwise(ty.cast(b, kind).col), kind)


@lazy("case")
def case(bind, e):
    if len(e.args) % 2 == 0:
        raise QueryError("case needs an odd number of arguments")
    values = [bind(x) for x in (*e.args[1::2], e.args[-1])]
    kind = ty.common([v.type for v in values])
    out = ty.cast(values[-1], kind).col
    for test, value in reversed(list(zip(e.args[0:-1:2], values))):
        out = F.when(F.coalesce(bind.predicate(test), F.lit(False)), ty.cast(value, kind).col).otherwise(out)
    return Typed(out, kind)


@function("coalesce")
def coalesce(*xs):
    kind = ty.common([x.type for x in xs])
    cols = [ty.cast(x, kind).col for x in xs]
    return Typed(F.coalesce(*[F.nullif(c, F.lit("")) if kind in ("string", "guid", "dynamic") else c for c in cols]), kind)


def _extreme(pick, xs):
    kind = ty.common([x.type for x in xs])
    return Typed(pick(*[ty.cast(x, kind).col for x in xs]), kind)


@function("max_of")
def max_of(*xs):
    return _extreme(F.greatest, xs)


@function("min_of")
def min_of(*xs):
    return _extreme(F.least, xs)


@function("round")
def round_(x, digits=None):
    n = digits.value if digits is not None and digits.const else 0
    if digits is not None and not digits.const:
        scale = F.pow(F.lit(10.0), ty.as_real(digits))
        v = ty.as_real(x) * scale
        return real(F.signum(v) * F.floor(F.abs(v) + 0.5) / scale)
    return real(F.round(ty.as_real(x), int(n)))


@function("abs")
def abs_(x):
    return Typed(F.abs(x.col), x.type) if x.type in ("long", "timespan") else real(F.abs(ty.as_real(x)))


@function("pow")
def pow_(x, y):
    return real(F.pow(ty.as_real(x), ty.as_real(y)))


def _log(f):
    """Minus infinity at 0 and NaN below it, where Spark gives null."""

    def out(x):
        v = ty.as_real(x)
        return real(F.when(v > 0, f(v)).when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))))

    return out


function("log")(_log(F.ln))
function("log2")(_log(F.log2))
function("log10")(_log(F.log10))

for _name, _f in {"sqrt": F.sqrt, "ceiling": F.ceil, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "degrees": F.degrees, "radians": F.radians}.items():
    function(_name)(lambda x, f=_f: real(f(ty.as_real(x))))


@function("exp2")
def exp2(x):
    return real(F.pow(F.lit(2.0), ty.as_real(x)))


@function("exp10")
def exp10(x):
    return real(F.pow(F.lit(10.0), ty.as_real(x)))


@function("pi")
def pi():
    return real(F.pi())


@function("sign")
def sign(x):
    return long(F.signum(ty.as_real(x)))


@function("atan2")
def atan2(y, x):
    return real(F.atan2(ty.as_real(y), ty.as_real(x)))


@function("isnan")
def isnan(x):
    v = ty.as_real(x)
    return boolean(F.when(v.isNotNull(), F.isnan(v)))


@function("isinf")
def isinf(x):
    return boolean(F.abs(ty.as_real(x)) == float("inf"))


@function("isfinite")
def isfinite(x):
    v = ty.as_real(x)
    return boolean(F.when(v.isNotNull(), ~F.isnan(v) & (F.abs(v) != float("inf"))))
