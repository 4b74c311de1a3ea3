"""Filters, projections, sorts, limits, joins and unions."""

from __future__ import annotations

import fnmatch

from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..lang import tree as t
from ..lang.lexer import QueryError
from ..plans import typed as ty
from ..plans.expr import path_text
from ..plans.frame import Frame, ref
from ..plans.typed import SPARK, Typed
from . import operator

NET = {"string": "System.String", "long": "System.Int64", "int": "System.Int32", "real": "System.Double", "bool": "System.SByte", "datetime": "System.DateTime", "timespan": "System.TimeSpan", "guid": "System.Guid", "dynamic": "System.Object"}


def item_name(item: t.Item) -> str:
    """The name of a projected column; without one, the expression's own text."""
    return item.name or path_text(item.expr) or getattr(item.expr, "text", "") or "Column1"


def column(frame: Frame, name: str) -> str:
    if name not in frame.types:
        raise QueryError(f"unknown column {name}")
    return name


def whole(scope, frame: Frame, e) -> int:
    x = scope.binder(frame)(e)
    if not x.const or not isinstance(x.value, (int, float)):
        x = scope.folded(x)
    return int(x.value)


@operator("where")
def where(scope, frame, op):
    frame, e = scope.semi_joins(frame, op.args["expr"])
    if e is None:
        return frame
    return frame.with_df(frame.df.filter(scope.binder(frame).predicate(e)))


@operator("project")
def project(scope, frame, op):
    bind, out = scope.binder(frame), {}
    for item in op.args["items"]:
        if isinstance(item.expr, t.Star):
            out |= frame.names
            continue
        x = bind(item.expr)
        out[item_name(item)] = ty.cast(x, "string") if x.type == "null" else x
    return frame.select(out)


@operator("extend")
def extend(scope, frame, op):
    bind, new = scope.binder(frame), {}
    for item in op.args["items"]:
        x = bind(item.expr)
        new[item_name(item)] = ty.cast(x, "string") if x.type == "null" else x
    order = frame.order if not any(n in new for n, _ in frame.order) else ()
    return frame.select(frame.names | new, order=order)


@operator("project-away")
def project_away(scope, frame, op):
    drop = [n.lower() for n in op.args["names"]]
    kept = {n: x for n, x in frame.names.items() if not any(fnmatch.fnmatchcase(n.lower(), d) for d in drop)}
    if not kept:
        raise QueryError("project-away cannot remove all columns")
    return frame.select(kept)


@operator("project-keep")
def project_keep(scope, frame, op):
    keep = [n.lower() for n in op.args["names"]]
    return frame.select({n: x for n, x in frame.names.items() if any(fnmatch.fnmatchcase(n.lower(), d) for d in keep)})


@operator("project-reorder")
def project_reorder(scope, frame, op):
    first = {}
    for pattern in op.args["names"]:
        first |= {n: x for n, x in frame.names.items() if fnmatch.fnmatchcase(n.lower(), pattern.lower())}
    return frame.select(first | frame.names | first)


@operator("project-rename")
def project_rename(scope, frame, op):
    new = {old: name for name, old in op.args["pairs"]}
    order = tuple((new.get(n, n), a) for n, a in frame.order)
    return frame.select({new.get(n, n): x for n, x in frame.names.items()}, order=order)


@operator("project-by-names")
def project_by_names(scope, frame, op):
    names: list[str] = []
    for kind, value in op.args["items"]:
        if kind == "of":
            names += list(scope.table(value).types)
        elif kind == "expr":
            found = scope.binder(frame)(value).value
            names += found if isinstance(found, list) else [found]
        elif value not in frame.types and (let := scope.scalar(value)) is not None:
            names += let.value if isinstance(let.value, list) else [let.value]
        else:
            names += [n for n in frame.types if fnmatch.fnmatchcase(n, value)]
    return frame.select({n: frame.names[n] for n in names if n in frame.types})


@operator("as")
def as_(scope, frame, op):
    scope.tables[op.args["name"]] = frame
    return frame


@operator("render")
def render(scope, frame, op):
    return Frame(frame.df, frame.types, frame.keys, frame.order, frame.marks | {"render": op.args["chart"]})


@operator("getschema")
def getschema(scope, frame, op):
    rows = [(n, i, NET.get(k, "System.String"), k) for i, (n, k) in enumerate(frame.types.items())]
    df = scope.spark.createDataFrame(rows, S.StructType([S.StructField("ColumnName", S.StringType()), S.StructField("ColumnOrdinal", S.LongType()), S.StructField("DataType", S.StringType()), S.StructField("ColumnType", S.StringType())]))
    return Frame(df, {"ColumnName": "string", "ColumnOrdinal": "long", "DataType": "string", "ColumnType": "string"})


@operator("count")
def count(scope, frame, op):
    one = F.count(F.lit(1)).alias("Count")
    df = frame.df.groupBy(*map(ref, frame.keys)).agg(one) if frame.keys else frame.df.agg(one)
    return Frame(df, {"Count": "long"}, frame.keys)


@operator("distinct")
def distinct(scope, frame, op):
    names = [column(frame, n) for n in op.args["names"]]
    df = frame.df.select(*map(ref, names), *map(ref, frame.keys)).distinct()
    return Frame(df, {n: frame.types[n] for n in names}, frame.keys)


@operator("sample-distinct")
def sample_distinct(scope, frame, op):
    out = distinct(scope, frame, t.Op("distinct", {"names": [op.args["name"]]}))
    return take(scope, out, op)


def first_rows(frame: Frame, n: int) -> Frame:
    if not frame.keys:
        df = frame.df.orderBy(*frame.sort_columns()) if frame.order else frame.df
        return frame.with_df(df.limit(n))
    frame = frame.numbered()
    return frame.with_df(frame.df.withColumn("__at", F.row_number().over(frame.window())).filter(F.col("__at") <= n).drop("__at"))


@operator("take", "limit")
def take(scope, frame, op):
    return first_rows(frame, whole(scope, frame, op.args["n"]))


@operator("sample")
def sample(scope, frame, op):
    n = whole(scope, frame, op.args["n"])
    mixed = frame.with_df(frame.df.withColumn("__mix", F.rand()), order=(("__mix", True),))
    out = first_rows(mixed, n)
    return out.with_df(out.df.drop("__mix"), order=())


@operator("order", "sort")
def order(scope, frame, op):
    """The sort is kept as a property; whoever needs the rows in order applies it, and takes become top-k."""
    keys = tuple((column(frame, n), asc) for n, asc in op.args["keys"])
    later = tuple(k for k in frame.order if k[0] not in {n for n, _ in keys})
    return frame.with_df(frame.df, order=keys + later)


@operator("top")
def top(scope, frame, op):
    return first_rows(order(scope, frame, op), whole(scope, frame, op.args["n"]))


@operator("union")
def union(scope, frame, op):
    return unite(([frame] if frame is not None else []) + [scope.query(q) for q in op.args["parts"]])


def unite(frames: list[Frame]) -> Frame:
    """Bag union by name; the first table's type holds for a column."""
    types: dict[str, str] = {}
    for f in frames:
        types = types | {n: k for n, k in f.types.items() if n not in types}
    out = None
    for f in frames:
        names = f.names
        cols = [(ty.cast(names[n], k).col if n in names else F.lit(None).cast(SPARK[k])).alias(n) for n, k in types.items()]
        df = f.df.select(*cols, *[ref(k) for k in frames[0].keys if k in f.df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return Frame(out, types, frames[0].keys)


@operator("lookup")
def lookup(scope, frame, op):
    return join(scope, frame, op)


@operator("join")
def join(scope, frame, op):
    """Equality joins in which null meets null.  Spark picks broadcast or sort-merge by size and splits skewed keys."""
    kind = {"semi": "leftsemi", "leftantisemi": "leftanti", "anti": "leftanti", "rightantisemi": "rightanti"}.get(op.args["join"], op.args["join"])
    right, keys = scope.query(op.args["right"]), op.args["keys"]
    if kind in ("rightsemi", "rightanti"):
        left = frame
        frame, right, keys = right, left, [(b, a) for a, b in keys]
        if kind == "rightsemi":
            frame = first_per(frame, [a for a, _ in keys])
        kind = kind.replace("right", "left")
    if kind == "innerunique":
        frame, kind = first_per(frame, [a for a, _ in keys]), "inner"
    lefts = {n: f"__l{i}" for i, n in enumerate(frame.types)}
    rights = {n: f"__r{i}" for i, n in enumerate(right.types)}
    a = frame.df.select(*[ref(n).alias(c) for n, c in lefts.items()], *map(ref, frame.hidden))
    b = right.df.select(*[ref(n).alias(c) for n, c in rights.items()])
    condition, possible = F.lit(True), True
    for x, y in keys:
        k, m = frame.types[column(frame, x)], right.types[column(right, y)]
        possible &= k == m or k in ("int", "long") and m in ("int", "long")
        one = ref(lefts[x]).eqNullSafe(ref(rights[y])) if k == m or possible else F.lit(False)
        condition = one if condition is None else condition & one
    how = {"inner": "inner", "leftouter": "left", "rightouter": "right", "fullouter": "full", "leftsemi": "left_semi", "leftanti": "left_anti"}[kind]
    df = a.join(b, condition, how)
    out = {n: Typed(ref(c), frame.types[n]) for n, c in lefts.items()}
    if kind not in ("leftsemi", "leftanti"):
        gone = {y for _, y in keys}
        for n, c in rights.items():
            if n not in gone:
                out[n if n not in out else n + "1"] = Typed(ref(c), right.types[n])
    df = df.select(*[x.col.alias(n) for n, x in out.items()], *[ref(h) for h in frame.hidden])
    return Frame(df, {n: x.type for n, x in out.items()}, frame.keys)


def first_per(frame: Frame, keys: list[str]) -> Frame:
    """The first row for each key, by a partial aggregation rather than a window."""
    frame = frame.numbered()
    by = [(ref(n).asc_nulls_first() if asc else None, n) for n, asc in frame.order]
    if any(c is None for c, _ in by):  # a descending sort has no struct to take the minimum of
        df = frame.df.withColumn("__at", F.row_number().over(frame.with_df(frame.df, keys=tuple(keys)).window())).filter("__at = 1").drop("__at")
        return frame.with_df(df)
    mark = F.struct(*[ref(n).isNotNull() for n, _ in by], *[ref(n) for n, _ in by], *([F.col("__order")] if "__order" in frame.df.columns else []))
    rows = F.struct(*[ref(c) for c in frame.df.columns])
    df = frame.df.groupBy(*[ref(k) for k in dict.fromkeys([*keys, *frame.keys])]).agg(F.min_by(rows, mark).alias("__row")).select("__row.*")
    return frame.with_df(df)
