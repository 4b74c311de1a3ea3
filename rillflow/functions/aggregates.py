"""Aggregate functions: each gives a Spark aggregate and its type.

All are partial-then-final aggregates.  Those whose result follows the rows'
order (lists, sets, first of ties) carry an order column beside the value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang import tree as t
from ..lang.lexer import QueryError
from ..plans import typed as ty
from ..plans.expr import Binder
from ..plans.typed import Typed, as_json, text
from .dynamics import bag_map, map_json, merge_maps
from .registry import json_array, json_reals

ALIASES = {"count_distinct": "dcount", "count_distinctif": "dcountif", "take_any": "any", "take_anyif": "anyif", "any_value": "any", "percentiles": "percentile"}
#: Aggregates whose last argument is a condition, and the one they restrict.
CONDITIONAL = {"sumif": "sum", "avgif": "avg", "minif": "min", "maxif": "max", "dcountif": "dcount", "make_set_if": "make_set", "make_list_if": "make_list", "make_bag_if": "make_bag", "anyif": "any", "stdevif": "stdev", "varianceif": "variance", "variancepif": "variancep", "covarianceif": "covariance", "covariancepif": "covariancep"}
NAMES = {"count", "countif", "sum", "avg", "min", "max", "dcount", "make_set", "make_list", "make_list_with_nulls", "make_bag", "arg_max", "arg_min", "any", "percentile", "percentiles_array", "stdev", "variance", "stdevp", "variancep", "covariance", "covariancep", "binary_all_or", "binary_all_and", "binary_all_xor", "strcat_delim", *ALIASES, *CONDITIONAL}
ORDERED = {"make_set", "make_list", "make_list_with_nulls", "make_set_if", "make_list_if", "make_bag", "make_bag_if", "strcat_delim", "any", "take_any", "anyif", "take_anyif", "arg_max", "arg_min"}


def number(arg) -> float:
    if isinstance(arg, t.Lit) and arg.type in ("long", "real"):
        return float(arg.value)
    raise QueryError("a percentile must be a number")


def _in_order(value: Column, order: Column, keep: Column | None = None) -> Column:
    """The values of a group in row order; ``keep`` false drops one."""
    item = F.struct(order.alias("o"), value.alias("v"))
    return F.transform(F.array_sort(F.collect_list(F.when(keep, item) if keep is not None else item)), lambda x: x["v"])


def aggregate(call: t.Call, bind: Binder, order: Column) -> Typed:
    name = ALIASES.get(call.name, call.name)
    args, when = list(call.args), None
    if name in CONDITIONAL:
        if len(args) < 2:
            raise QueryError(f"{call.name} needs a condition")
        when = F.coalesce(bind.predicate(args.pop()), F.lit(False))
        name = CONDITIONAL[name]

    def arg(i: int) -> Typed:
        if i >= len(args):
            raise QueryError(f"{call.name}: an argument is missing")
        x = bind(args[i])
        return x if when is None else Typed(F.when(when, x.col), x.type)

    def num(i: int = 0) -> Column:
        return ty.as_real(arg(i))

    if name == "count":
        return Typed(F.count(F.lit(1)), "long")
    if name == "countif":
        return Typed(F.count_if(F.coalesce(bind.predicate(args[0]), F.lit(False))), "long")
    if name == "sum":
        return Typed(F.coalesce(F.sum(num()), F.lit(0.0)), "real")
    if name == "avg":
        return Typed(F.avg(num()), "real")
    if name in ("min", "max"):
        x = arg(0)
        return Typed((F.min if name == "min" else F.max)(x.col), x.type)
    if name == "dcount":
        x = arg(0)
        return Typed(F.count_distinct(text(x) if x.type == "dynamic" else x.col), "long")
    if name in ("make_list", "make_set", "make_list_with_nulls"):
        x = arg(0)
        value = as_json(x)
        keep = None if name == "make_list_with_nulls" else x.col.isNotNull()
        out = _in_order(value, order, keep)
        return Typed(F.coalesce(json_array(F.array_distinct(out) if name == "make_set" else out), F.lit("[]")), "dynamic")
    if name == "make_bag":
        x = arg(0)
        maps = F.filter(F.transform(_in_order(x.col, order, x.col.isNotNull()), bag_map), lambda m: m.isNotNull())
        merged = F.aggregate(maps, F.create_map().cast("map<string,string>"), lambda a, b: merge_maps(b, a))
        return Typed(map_json(merged), "dynamic")
    if name in ("arg_max", "arg_min"):
        x, ret = arg(0), arg(1)
        return Typed(argument(name, x, order, F.struct(ret.col.alias("v")))["v"], ret.type)
    if name == "any":
        x = arg(0)
        return Typed(F.min_by(x.col, F.when(x.col.isNotNull(), order)), x.type)
    if name == "percentile":
        return Typed(F.percentile(num(), F.lit(number(args[1]) / 100)), "real")
    if name == "percentiles_array":
        ps = [bind(args[1])] if len(args) == 2 else []
        if ps and isinstance(ps[0].value, list):
            wanted = [float(p) for p in ps[0].value]
        else:
            wanted = [number(a) for a in args[1:]]
        return Typed(json_reals(F.percentile(num(), F.array(*[F.lit(p / 100) for p in wanted]))), "dynamic")
    plain = {"stdev": F.stddev_samp, "variance": F.var_samp, "stdevp": F.stddev_pop, "variancep": F.var_pop}
    if name in plain:
        return Typed(plain[name](num()), "real")
    if name in ("covariance", "covariancep"):
        x, y = num(0), num(1)
        both = x.isNotNull() & y.isNotNull()
        f = F.covar_samp if name == "covariance" else F.covar_pop
        out = f(F.when(both, x), F.when(both, y))
        return Typed(F.when(F.count(F.when(both, 1)) > (1 if name == "covariance" else 0), out), "real")
    if name.startswith("binary_all_"):
        f = {"or": F.bit_or, "and": F.bit_and, "xor": F.bit_xor}[name[11:]]
        return Typed(F.coalesce(f(ty.as_long(arg(0))), F.lit(0).cast("bigint")), "long")
    if name == "strcat_delim":
        x = bind(args[1])
        return Typed(F.call_function("array_join", _in_order(text(x), order, x.col.isNotNull()), text(bind(args[0]))), "string")
    raise QueryError(f"unknown aggregate {call.name}")


def argument(name: str, x: Typed, order: Column, row: Column) -> Column:
    """The struct ``row`` of the row with the extreme of x; of equals the first, and if all are null the first of all."""
    if name == "arg_max":
        return F.max_by(row, F.struct(x.col.isNotNull().alias("h"), x.col.alias("x"), (-order).alias("o")))
    return F.min_by(row, F.struct(x.col.isNull().alias("h"), x.col.alias("x"), order.alias("o")))

