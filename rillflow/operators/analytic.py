"""serialize with its window functions, scan, and invoke."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..lang import tree as t
from ..lang.lexer import QueryError
from ..plans import typed as ty
from ..plans.expr import Binder
from ..plans.frame import Frame, ref
from ..plans.typed import SPARK, Typed
from . import operator
from .relational import item_name


@operator("serialize")
def serialize(scope, frame, op):
    frame = frame.numbered()
    bind, new = scope.binder(frame), {}
    for item in op.args["items"]:
        e = item.expr
        if isinstance(e, t.Call) and e.name in ("row_number", "prev", "next"):
            window = frame.window()
            if e.name == "row_number":
                x = Typed(F.row_number().over(window).cast("bigint"), "long")
            else:
                value = bind(e.args[0])
                n = int(scope.folded(bind(e.args[1])).value) if len(e.args) > 1 else 1
                moved = (F.lag if e.name == "prev" else F.lead)(F.struct(value.col.alias("v")), n).over(window)
                x = Typed(moved["v"], value.type)
                if len(e.args) > 2:
                    default = ty.cast(bind(e.args[2]), value.type)
                    x = Typed(F.when(moved.isNull(), default.col).otherwise(moved["v"]), value.type)
        else:
            x = bind(e)
        new[item_name(item)] = x
    return frame.select(frame.names | new)


def _reads(e, name: str) -> bool:
    """Whether an expression reads the state of the step ``name``."""
    if isinstance(e, t.Member) and isinstance(e.base, t.Name) and e.base.name == name:
        return True
    parts = [getattr(e, a) for a in ("left", "right", "arg", "base", "low", "high") if hasattr(e, a)]
    parts += list(getattr(e, "args", ())) + list(getattr(e, "items", ()))
    return any(_reads(p, name) for p in parts if not isinstance(p, str))


@operator("scan")
def scan(scope, frame, op):
    """A state machine of one step over the rows in order.

    A running sum (``s = step.s + x`` under a condition that reads no state) is a
    window.  Any other step folds the ordered rows of a group in one aggregate.
    """
    name, cond, sets = op.args["step"]
    declared = {n: (k, d) for n, k, d in op.args["declared"]}
    frame = frame.numbered()
    bind = scope.binder(frame)
    types = frame.types | {n: k for n, (k, _) in declared.items()}
    free = not _reads(cond, name)
    if free and all(_sum_of(e, name, c) is not None for c, e in sets) and all(declared[c][0] in ("long", "real") for c, _ in sets):
        kept = frame.with_df(frame.df.filter(bind.predicate(cond)))
        window, new = kept.window().rowsBetween(W.unboundedPreceding, 0), {}
        for c, e in sets:
            kind, default = declared[c]
            start = ty.cast(bind(default), kind).col if default is not None else F.lit(0).cast(SPARK[kind])
            new[c] = Typed((start + F.sum(ty.cast(bind(_sum_of(e, name, c)), kind).col).over(window)).cast(SPARK[kind]), kind)
        for c, (kind, default) in declared.items():
            if c not in new:
                new[c] = ty.cast(bind(default), kind) if default is not None else Typed(F.lit(None).cast(SPARK[kind]), kind)
        return kept.select(kept.names | new)
    order = [F.row_number().over(frame.window()).alias("__at")]
    rows = frame.df.select("*", *order)
    row = F.struct(F.col("__at"), *[ref(n) for n in frame.types])
    groups = [ref(k) for k in frame.keys]
    collected = rows.groupBy(*groups).agg(F.array_sort(F.collect_list(row)).alias("__rows")) if groups else rows.agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    state = [(n, k) for n, (k, _) in declared.items()]
    start = F.struct(*[(ty.cast(bind(d), k).col if d is not None else F.lit(None).cast(SPARK[k])).alias(n) for n, (k, d) in declared.items()])
    out_type = "struct<" + ",".join(f"`{n}`:{SPARK[k]}" for n, k in types.items()) + ">"
    first = F.struct(start.alias("s"), F.array().cast(f"array<{out_type}>").alias("out"))

    def step(acc, r):
        names = {n: Typed(r[n], k) for n, k in frame.types.items()} | {n: Typed(acc["s"][n], k) for n, k in state if n not in frame.types}
        inner = Binder(names, scope, {name: {n: Typed(acc["s"][n], k) for n, k in state}})
        now = dict(inner.extra[name])
        for c, e in sets:  # later assignments see earlier ones
            inner.names[c] = now[c] = ty.cast(inner(e), declared[c][0]) if c in declared else inner(e)
        new = F.struct(*[now[n].col.alias(n) for n, _ in state])
        shown = F.struct(*[(now[n].col if n in declared else r[n]).cast(SPARK[k]).alias(n) for n, k in types.items()])
        hit = F.coalesce(Binder({n: Typed(r[n], k) for n, k in frame.types.items()} | {n: Typed(acc["s"][n], k) for n, k in state if n not in frame.types}, scope, inner.extra).predicate(cond), F.lit(False))
        return F.struct(F.when(hit, new).otherwise(acc["s"]).alias("s"), F.when(hit, F.concat(acc["out"], F.array(shown))).otherwise(acc["out"]).alias("out"))

    folded = collected.select(*groups, F.posexplode(F.aggregate("__rows", first, step, lambda a: a["out"])).alias("__order", "__row"))
    return Frame(folded.select(*[F.col("__row")[n].alias(n) for n in types], "__order", *groups), types, frame.keys)


def _sum_of(e, name: str, column: str):
    """x in ``step.column + x``, where x reads no state."""
    if isinstance(e, t.Binary) and e.op == "+":
        for a, b in ((e.left, e.right), (e.right, e.left)):
            if isinstance(a, t.Member) and isinstance(a.base, t.Name) and a.base.name == name and a.key == column and not _reads(b, name):
                return b
    return None


@operator("invoke")
def invoke(scope, frame, op):
    call = op.args["call"]
    if not isinstance(call, t.Call):
        raise QueryError("invoke needs a call")
    return scope.call_tabular(call.name, list(call.args), frame)
