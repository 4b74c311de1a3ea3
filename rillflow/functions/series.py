"""Arrays of numbers, element by element, as higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import typed as ty
from ..plans.typed import Typed
from .registry import dynamic, elementwise, function, json_array, json_object, let, numbers, real, reals


def _binary(op):
    return lambda a, b: elementwise(op, a, b)


def _compared(op):
    return lambda a, b: dynamic(json_array(F.transform(F.zip_with(reals(a), reals(b), op), lambda x: x.cast("string"))))


for _name, _op in {"add": lambda x, y: x + y, "subtract": lambda x, y: x - y, "multiply": lambda x, y: x * y, "divide": lambda x, y: F.when(y != 0, x / F.when(y != 0, y)), "pow": lambda x, y: F.pow(x, y)}.items():
    function("series_" + _name)(_binary(_op))
for _name, _op in {"equals": lambda x, y: x == y, "not_equals": lambda x, y: x != y, "less": lambda x, y: x < y, "less_equals": lambda x, y: x <= y, "greater": lambda x, y: x > y, "greater_equals": lambda x, y: x >= y}.items():
    function("series_" + _name)(_compared(_op))
_ln = lambda x: F.when(x > 0, F.ln(x))
for _name, _op in {"abs": F.abs, "sign": F.signum, "ceiling": F.ceil, "floor": F.floor, "log": _ln, "exp": F.exp, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan}.items():
    function("series_" + _name)(lambda x, f=_op, finite=_name in ("abs", "sign", "sin", "cos", "atan"): elementwise(lambda v: f(v).cast("double"), x, finite=finite))


def _missing(x: Typed, placeholder: Typed | None) -> Column:
    """The numbers with the placeholder as null."""
    values = reals(x)
    if placeholder is None or placeholder.value is None and placeholder.const:
        return values
    return F.transform(values, lambda v: F.when(v != ty.as_real(placeholder), v))


def _forward(values: Column) -> Column:
    start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last"))
    step = lambda s, v: F.struct(F.concat(s["out"], F.array(F.coalesce(v, s["last"]))).alias("out"), F.coalesce(v, s["last"]).alias("last"))
    return F.aggregate(values, start, step, lambda s: s["out"])


@function("series_fill_forward")
def fill_forward(x, placeholder=None):
    return numbers(_forward(_missing(x, placeholder)))


@function("series_fill_backward")
def fill_backward(x, placeholder=None):
    return numbers(F.reverse(_forward(F.reverse(_missing(x, placeholder)))))


@function("series_fill_const")
def fill_const(x, value, placeholder=None):
    return numbers(F.transform(_missing(x, placeholder), lambda v: F.coalesce(v, ty.as_real(value))))


@function("series_fill_linear")
def fill_linear(x, placeholder=None, edges=None, constant=None):
    fill = edges is None or edges.value is not False
    other = ty.as_real(constant) if constant is not None else F.lit(0.0)

    def filled(v: Column) -> Column:
        at = F.transform(v, lambda y, i: F.when(y.isNotNull(), i.cast("double")))
        sides = F.struct(v.alias("v"), _forward(at).alias("before"), F.reverse(_forward(F.reverse(at))).alias("after"))
        return F.when(F.exists(v, lambda y: y.isNotNull()), let(sides, lined)).otherwise(F.transform(v, lambda _: other))

    def lined(s: Column) -> Column:
        def one(y, i):
            a, b = F.get(s["before"], i), F.get(s["after"], i)
            low, high = F.get(s["v"], a.cast("int")), F.get(s["v"], b.cast("int"))
            line = low + (high - low) * (i - a) / F.when(b > a, b - a)
            edge = F.coalesce(low, high) if fill else F.lit(None).cast("double")
            return F.coalesce(y, F.when(a.isNotNull() & b.isNotNull(), line).otherwise(edge))

        return F.transform(s["v"], one)

    return numbers(let(_missing(x, placeholder), filled))


def total(values: Column, start: float, step) -> Column:
    return F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(start), step)


@function("series_sum")
def series_sum(x):
    return real(total(reals(x), 0.0, lambda s, v: s + v))


@function("series_product")
def series_product(x):
    return real(total(reals(x), 1.0, lambda s, v: s * v))


@function("series_magnitude")
def series_magnitude(x):
    return real(F.sqrt(total(reals(x), 0.0, lambda s, v: s + v * v)))


@function("series_pearson_correlation")
def pearson(a, b):
    def means(s: Column) -> Column:
        n = F.size(s["x"]).cast("double")
        mean = lambda v: total(v, 0.0, lambda t, y: t + y) / n
        return F.struct(s["x"].alias("x"), s["y"].alias("y"), mean(s["x"]).alias("mx"), mean(s["y"]).alias("my"))

    def sums(s: Column) -> Column:
        x, y, mx, my = s["x"], s["y"], s["mx"], s["my"]
        square = lambda v, m: total(v, 0.0, lambda t, p: t + (p - m) * (p - m))
        both = total(F.zip_with(x, y, lambda p, q: (p - mx) * (q - my)), 0.0, lambda t, v: t + v)
        whole = (F.size(x) == F.size(y)) & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull()) & F.forall(y, lambda v: v.isNotNull())
        return F.struct(square(x, mx).alias("sx"), square(y, my).alias("sy"), both.alias("both"), whole.alias("whole"))

    out = lambda s: F.when(s["whole"] & (s["sx"] > 0) & (s["sy"] > 0), s["both"] / F.sqrt(s["sx"] * s["sy"]))
    return real(let(F.struct(reals(a).alias("x"), reals(b).alias("y")), lambda s: let(means(s), lambda t: let(sums(t), out))))


@function("series_stats_dynamic")
def stats(x):
    text = lambda c: F.coalesce(ty.real_text(c.cast("double")), F.lit("null"))

    def moments(s: Column) -> Column:
        """sum, mean and variance beside the numbers, with and without nulls."""
        n = F.size(s["v"])
        spread = lambda m: total(s["v"], 0.0, lambda t, y: t + (y - m) * (y - m))
        mean = s["sum"] / F.when(n > 0, n)
        variance = F.when(n > 1, let(mean, spread) / F.when(n > 1, n - 1)).otherwise(0.0)
        return F.struct(s["all"].alias("all"), F.array_min(s["v"]).alias("low"), F.array_max(s["v"]).alias("high"), mean.alias("mean"), variance.alias("variance"), s["sum"].alias("sum"))

    def shown(m: Column) -> Column:
        place = lambda y: F.coalesce((F.array_position(m["all"], y) - 1).cast("string"), F.lit("null"))
        pairs = {"min": text(m["low"]), "min_idx": place(m["low"]), "max": text(m["high"]), "max_idx": place(m["high"]), "avg": text(m["mean"]), "variance": text(m["variance"]), "stdev": text(F.sqrt(m["variance"])), "sum": text(m["sum"]), "len": F.size(m["all"]).cast("string")}
        return json_object(list(pairs.items()))

    def out(all_: Column) -> Column:
        v = F.filter(all_, lambda y: y.isNotNull())
        sums = F.struct(all_.alias("all"), v.alias("v"), total(v, 0.0, lambda s, y: s + y).alias("sum"))
        return F.when(all_.isNotNull(), let(sums, lambda s: let(moments(s), shown)))

    return dynamic(let(reals(x), out))
