"""mv-expand, mv-apply, partition and evaluate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dynamics import jsons
from ..lang import tree as t
from ..lang.lexer import QueryError
from ..plans import typed as ty
from ..plans.frame import Frame, ref
from ..plans.typed import Typed
from . import operator
from .relational import item_name


def expanded(scope, frame: Frame, items: list) -> Frame:
    """One row for each place of the arrays side by side; a row without any array stays, one with empty arrays alone goes."""
    bind = scope.binder(frame)
    made = [(item_name(i), bind(i.expr), kind) for i, kind in items]
    lists = [jsons(ty.cast(x, "dynamic")) for _, x, _ in made]
    some = F.coalesce(*lists).isNotNull()
    whole = F.array(F.struct(*[F.when(l.isNull(), ty.cast(x, "dynamic").col).alias(f"c{i}") for i, (l, (_, x, _)) in enumerate(zip(lists, made))]))
    size = F.greatest(*[F.coalesce(F.size(l), F.lit(0)) for l in lists], F.lit(0))
    # Arrays of other lengths are padded with null; what is no array beside one gives null.
    rows = F.transform(F.filter(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0))), lambda i: i < size), lambda i: F.struct(*[F.get(l, i).alias(f"c{k}") for k, l in enumerate(lists)]))
    df = frame.df.withColumn("__x", F.explode(F.when(some, rows).otherwise(whole)))
    out = dict(frame.names)
    for i, (name, x, kind) in enumerate(made):
        value = Typed(F.nullif(F.col(f"__x.c{i}"), F.lit("null")), "dynamic")
        out[name] = ty.cast(value, kind) if kind else value
    return Frame(df, frame.types, frame.keys).select(out).with_df(df.select(*[x.col.alias(n) for n, x in out.items()], *[ref(h) for h in frame.hidden]))


@operator("mv-expand")
def mv_expand(scope, frame, op):
    return expanded(scope, frame, op.args["items"])


def sub_pipeline(scope, frame: Frame, key: str, ops: list[t.Op]) -> Frame:
    """Runs a pipeline once, parted by a hidden key, in place of once for each key."""
    outer = frame.keys
    inner = Frame(frame.df, frame.types, (*outer, key), frame.order)
    out = scope.apply(inner, ops)
    return Frame(out.df.drop(key), out.types, outer)


@operator("mv-apply")
def mv_apply(scope, frame, op):
    key = f"__row{len(frame.keys)}"
    marked = frame.with_df(frame.df.withColumn(key, F.monotonically_increasing_id()))
    inner = expanded(scope, marked, op.args["items"])
    out = sub_pipeline(scope, inner.numbered(), key, op.args["ops"])
    return Frame(out.df.drop("__order"), out.types, out.keys)


@operator("partition")
def partition(scope, frame, op):
    if op.args["name"] not in frame.types:
        raise QueryError(f"unknown column {op.args['name']}")
    key = f"__part{len(frame.keys)}"
    return sub_pipeline(scope, frame.with_df(frame.df.withColumn(key, ref(op.args["name"]))), key, op.args["ops"])


@operator("evaluate")
def evaluate(scope, frame, op):
    call = op.args["call"]
    plugin = scope.engine.plugins.get(call.name)
    if plugin is None:
        raise QueryError(f"unknown plugin {call.name}")
    return plugin(scope, frame, call, op.args["schema"])


def bag_unpack(scope, frame: Frame, call: t.Call, schema) -> Frame:
    """A bag's keys as columns.  Without a schema the keys come from one pass over the column."""
    plain = [a for a in call.args if not isinstance(a, t.Item)]
    named = {a.name: a.expr for a in call.args if isinstance(a, t.Item)}
    bag = plain[0].name
    prefix = plain[1].value if len(plain) > 1 else scope.binder(frame)(named["OutputColumnPrefix"]).value if "OutputColumnPrefix" in named else ""
    conflict = scope.binder(frame)(named["columnsConflict"]).value if "columnsConflict" in named else "error"
    ignored = scope.binder(frame)(named["ignoredProperties"]).value if "ignoredProperties" in named else []
    parsed = F.try_variant_get(F.try_parse_json(ref(bag)), "$", "map<string,variant>")
    if schema is None:
        keyed = frame.df.select(F.explode(parsed).alias("k", "v")).select("k", F.schema_of_variant("v").alias("s"))
        found = keyed.groupBy("k").agg(F.collect_set("s").alias("s")).orderBy("k").collect()
        kinds = {}
        for r in found:
            s = {x.split("(")[0] for x in r.s} - {"VOID"}
            kinds[r.k] = "long" if s == {"BIGINT"} else "real" if s and s <= {"BIGINT", "DOUBLE", "DECIMAL"} else "bool" if s == {"BOOLEAN"} else "string" if s == {"STRING"} or not s else "dynamic"
    else:
        kinds = dict(schema)
    out = {n: x for n, x in frame.names.items() if n != bag}
    new = {}
    for key, kind in kinds.items():
        if key in (ignored or []) or schema is not None and key in out:
            continue
        name = prefix + key
        value = Typed(F.nullif(F.to_json(F.try_element_at(parsed, F.lit(key))), F.lit("null")), "dynamic")
        if name in out:
            if conflict == "error":
                raise QueryError(f"bag_unpack: column {name} exists")
            if conflict == "keep_source":
                continue
            del out[name]
        new[name] = ty.cast(value, kind)
    return frame.select(out | new)
