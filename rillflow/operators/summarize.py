"""summarize and make-series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as ag
from ..functions.registry import json_array
from ..lang import tree as t
from ..lang.lexer import QueryError
from ..plans import typed as ty
from ..plans.expr import path_text
from ..plans.frame import ORDER, Frame, ref
from ..plans.typed import Typed
from . import operator


def by_name(item: t.Item) -> str:
    if item.name:
        return item.name
    if name := path_text(item.expr):
        return name
    if isinstance(item.expr, t.Call):
        for a in item.expr.args:
            if name := path_text(a):
                return name
        return item.expr.name + "_"
    return "expr_"


def agg_name(item: t.Item) -> str:
    call = item.expr
    if item.name:
        return item.name
    first = path_text(call.args[0]) if call.args else None
    if call.name in ("arg_max", "arg_min"):
        return (path_text(call.args[1]) if len(call.args) > 1 else first) or call.name + "_"
    if call.name.startswith("covariance"):
        return "_".join([call.name, *[path_text(a) or "" for a in call.args[:2]]])
    if call.name == "percentiles_array":
        return f"percentiles_{first or ''}"
    if call.name == "strcat_delim" and len(call.args) > 1:
        return f"strcat_delim_{path_text(call.args[1]) or ''}"
    return f"{call.name}_{first or ''}"


def unique(name: str, taken) -> str:
    n, out = 0, name
    while out in taken:
        n += 1
        out = f"{name}{n}"
    return out


@operator("summarize")
def summarize(scope, frame, op):
    calls = op.args["aggs"]
    for item in calls:
        if not isinstance(item.expr, t.Call) or item.expr.name not in ag.NAMES:
            raise QueryError("summarize takes aggregates only")
    ordered = any(i.expr.name in ag.ORDERED for i in calls)
    if ordered and frame.order:
        # The sort is a range shuffle; numbers rise from one of its partitions to the next, with no window over all rows.
        frame = frame.with_df(frame.df.orderBy(*frame.sort_columns(), *([ref(ORDER)] if ORDER in frame.df.columns else [])).withColumn(ORDER, F.monotonically_increasing_id()))
    elif ordered:
        frame = frame.numbered()
    bind = scope.binder(frame)
    by = {unique(by_name(i), ()): bind(i.expr) for i in op.args["by"]}
    by = {n: Typed(x.col, x.type) if x.type != "null" else ty.cast(x, "string") for n, x in by.items()}
    order = ref(ORDER) if ordered else F.lit(0)
    made: dict[str, tuple] = {}
    for item in calls:
        call = item.expr
        if call.name in ("arg_max", "arg_min") and any(isinstance(a, t.Star) for a in call.args[1:]):
            x = bind(call.args[0])
            rest = [n for n in frame.types if n not in by and n != path_text(call.args[0])]
            row = F.struct(x.col.alias("c0"), *[ref(n).alias(f"c{i + 1}") for i, n in enumerate(rest)])
            whole = ag.argument(call.name, x, order, row)
            first = item.name or path_text(call.args[0]) or agg_name(item)
            for i, n in enumerate([first, *rest]):
                made[unique(n, made)] = (whole[f"c{i}"], x.type if i == 0 else frame.types[n])
            continue
        if call.name in ("percentile", "percentiles") and len(call.args) > 2:
            for p in call.args[1:]:
                one = ag.aggregate(t.Call("percentile", (call.args[0], p)), bind, order)
                made[unique(f"percentile_{path_text(call.args[0]) or ''}_{ag.number(p):g}", made)] = (one.col, one.type)
            continue
        x = ag.aggregate(call, bind, order)
        made[unique(agg_name(item), (*made, *by))] = (x.col, x.type)
    groups = [x.col.alias(f"__by{i}") for i, x in enumerate(by.values())]
    aggs = [c.alias(f"__agg{i}") for i, (c, _) in enumerate(made.values())]
    keys = [ref(k) for k in frame.keys]
    if not aggs:
        df = frame.df.select(*groups, *keys).distinct()
    elif groups or keys:
        df = frame.df.groupBy(*groups, *keys).agg(*aggs)
    else:  # no rows in, no row out
        df = frame.df.agg(*aggs, F.count(F.lit(1)).alias("__n")).filter("__n > 0")
    cols = [F.col(f"__agg{i}").alias(n) for i, n in enumerate(made)] + [F.col(f"__by{i}").alias(unique(n, made)) for i, n in enumerate(by)]
    types = {n: k for n, (_, k) in made.items()} | {unique(n, made): x.type for n, x in by.items()}
    return Frame(df.select(*cols, *keys), types, frame.keys)


@operator("make-series")
def make_series(scope, frame, op):
    """Bins between from and to (exclusive) for each group, gaps filled by the default.

    Only bins that have rows are shuffled; a group's gaps are filled from a map of its bins.
    """
    bind = scope.binder(frame)
    axis = bind(t.Name(op.args["axis"]))
    step = scope.folded(bind(op.args["step"]))
    moments = axis.type == "datetime"
    to_long = (lambda x: ty.micros(ty.as_datetime(x))) if moments else ty.as_long
    width = int(step.value) // 10 if moments else step.value
    real = not moments and (isinstance(width, float) or axis.type == "real")

    def end(e, pick):
        if e is not None:
            return scope.number(to_long(bind(e)) if not real else ty.as_real(bind(e)))
        return frame.df.agg(pick(to_long(axis) if not real else ty.as_real(axis))).first()[0]

    low, high = end(op.args["low"], F.min), end(op.args["high"], F.max)
    if op.args["high"] is None and high is not None:
        high = high + width
    if not width or width < 0:
        raise QueryError("make-series needs a positive step")
    import math

    bins = 0 if low is None or high is None else max(0, math.ceil((high - low) / width))
    if bins > 1 << 20:
        raise QueryError("make-series has too many bins")
    low = low or 0
    at = (to_long(axis) if not real else ty.as_real(axis)) - F.lit(low)
    place = F.floor(at / F.lit(width)).cast("int")
    by = {by_name(i): bind(i.expr) for i in op.args["by"]}
    items = [(agg_name(i), ag.aggregate(i.expr, bind, F.lit(0)), bind(d)) for i, d in op.args["aggs"]]
    inside = frame.df.filter(axis.col.isNotNull() & (at >= 0) & (place < bins))
    keys = [x.col.alias(f"__by{i}") for i, x in enumerate(by.values())]
    hidden = [ref(k) for k in frame.keys]
    part = inside.groupBy(*keys, *hidden, place.alias("__bin")).agg(*[ty.as_real(x).alias(f"__v{i}") if x.type != "long" else x.col.alias(f"__v{i}") for i, (_, x, _) in enumerate(items)])
    names = [f"__by{i}" for i in range(len(by))]
    entry = F.struct("__bin", *[f"__v{i}" for i in range(len(items))])
    grouped = part.groupBy(*names, *hidden).agg(F.collect_list(entry).alias("__all")) if names or hidden else part.agg(F.collect_list(entry).alias("__all")).filter(F.size("__all") > 0)
    places = F.sequence(F.lit(0), F.lit(max(bins - 1, 0)))

    def filled(i, x, default):
        have = F.map_from_entries(F.transform("__all", lambda e: F.struct(e["__bin"], e[f"__v{i}"])))
        gap = ty.as_long(default) if x.type == "long" else ty.as_real(default)
        show = (lambda c: c.cast("string")) if x.type == "long" else ty.real_text
        return json_array(F.transform(places, lambda b: show(F.coalesce(F.try_element_at(have, b), gap))))

    out, types = [], {}
    for i, (name, x, default) in enumerate(items):
        out.append(filled(i, x, default).alias(name))
        types[name] = "dynamic"
    for i, (n, x) in enumerate(by.items()):
        out.append(F.col(f"__by{i}").alias(n))
        types[n] = x.type
    stamp = lambda b: F.lit(low) + b * F.lit(width)
    shown = F.transform(places, lambda b: F.concat(F.lit('"'), ty.datetime_text(F.timestamp_micros(stamp(b).cast("bigint"))), F.lit('"')) if moments else ty.real_text(stamp(b).cast("double")))
    out.append(json_array(shown).alias(op.args["axis"]))
    types[op.args["axis"]] = "dynamic"
    return Frame(grouped.select(*out, *hidden), types, frame.keys)
