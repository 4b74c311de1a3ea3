"""Materialized views: one grouped aggregation of a table, kept up by merging each batch of new rows.

A view stores partial states, one column or two for each aggregate; averages are
a sum and a count, distinct counts a set of (group, value) rows of their own, so
every aggregate is incremental.  A merge aggregates the delta, unites it with
the stored states and aggregates once more: no row of the table is read again.
``follow`` does the same from a stream of the table's files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates as ag
from ..lang import tree as t
from ..lang.lexer import QueryError
from ..lang.parser import parse_query
from ..operators.summarize import agg_name, by_name
from ..plans import typed as ty
from ..plans.frame import Frame, from_spark, ref
from ..plans.typed import Typed

ROWWISE = {"where", "extend", "project", "project-away", "project-rename", "project-keep", "project-reorder", "parse", "parse-where", "mv-expand"}
ALLOWED = {"count", "countif", "sum", "sumif", "avg", "avgif", "min", "minif", "max", "maxif", "dcount", "dcountif", "arg_max", "arg_min", "make_set", "make_list", "make_bag", "take_any", "any"}


def checked(text: str) -> t.Query:
    q = parse_query(text)
    if q.source.kind != "table" or not q.ops or q.ops[-1].kind != "summarize" or any(o.kind not in ROWWISE for o in q.ops[:-1]):
        raise QueryError("a view is a table, rowwise operators and one summarize at the end")
    for item in q.ops[-1].args["aggs"]:
        if item.expr.name not in ALLOWED:
            raise QueryError(f"{item.expr.name} is not for views")
    return q


class Plan:
    """How a view's states are made, merged and shown."""

    def __init__(self, engine, text: str, source: Frame):
        from ..engine import Scope

        self.query, self.scope = checked(text), Scope(engine)
        self.source_types = source.types
        self.by: dict[str, Typed] = {}
        self.items: list[tuple[str, t.Call, str]] = []
        frame = self.scope.apply(source, self.query.ops[:-1])
        bind = self.scope.binder(frame)
        last = self.query.ops[-1].args
        self.by = {by_name(i): bind(i.expr) for i in last["by"]}
        for i in last["aggs"]:
            call = i.expr
            if call.name in ("arg_max", "arg_min") and any(isinstance(a, t.Star) for a in call.args):
                first = i.name or agg_name(t.Item(None, t.Call(call.name, call.args[:1])))
                name = getattr(call.args[0], "name", None)
                self.items.append((name or first, t.Call(call.name, (call.args[0], call.args[0])), "arg"))
                for n in frame.types:
                    if n not in self.by and n != name:
                        self.items.append((n, t.Call(call.name, (call.args[0], t.Name(n, n))), "arg"))
            else:
                self.items.append((agg_name(i), call, "plain"))

    def states(self, rows: Frame) -> DataFrame:
        """Partial states of some rows of the table."""
        frame = self.scope.apply(rows, self.query.ops[:-1])
        bind = self.scope.binder(frame)
        frame = frame.with_df(frame.df.withColumn("__seen", F.struct(F.current_timestamp().alias("t"), F.monotonically_increasing_id().alias("i"))))
        order = F.col("__seen")
        groups = [bind(i.expr).col.alias(f"k{n}") for n, i in enumerate(self.query.ops[-1].args["by"])]
        aggs: list[Column] = []
        for n, (_, call, _) in enumerate(self.items):
            name, args, when = ag.ALIASES.get(call.name, call.name), list(call.args), None
            if name in ag.CONDITIONAL or name == "countif":
                when = F.coalesce(bind.predicate(args.pop()), F.lit(False))
                name = ag.CONDITIONAL.get(name, name)
            x = bind(args[0]) if args else None
            value = x.col if x is not None and when is None else F.when(when, x.col) if x is not None else None
            num = ty.as_real(Typed(value, x.type)) if x is not None else None
            if name == "count":
                made = [F.count(F.lit(1))]
            elif name == "countif":
                made = [F.count_if(when)]
            elif name == "sum":
                made = [F.coalesce(F.sum(num), F.lit(0.0))]
            elif name == "avg":
                made = [F.coalesce(F.sum(num), F.lit(0.0)), F.count(num)]
            elif name in ("min", "max"):
                made = [(F.min if name == "min" else F.max)(value)]
            elif name in ("arg_max", "arg_min"):
                ret = bind(call.args[1])
                rank = F.struct(value.isNotNull().alias("h"), value.alias("x")) if name == "arg_max" else F.struct(value.isNull().alias("h"), value.alias("x"))
                pick = F.max_by if name == "arg_max" else F.min_by
                made = [pick(F.struct(rank.alias("r"), ret.col.alias("v")), rank)]
            elif name == "any":
                made = [F.first(value, True)]
            elif name == "dcount":
                made = [F.collect_set(ty.text(Typed(value, x.type)))]
            else:
                made = [F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), (ty.as_json(x) if name != "make_bag" else x.col).alias("v")))))]
            aggs += [m.alias(f"s{n}_{k}") for k, m in enumerate(made)]
        if groups:
            return frame.df.groupBy(*groups).agg(*aggs)
        return frame.df.agg(*aggs, F.count(F.lit(1)).alias("__n")).filter("__n > 0").drop("__n")

    def merge(self, states: DataFrame) -> DataFrame:
        """States of the same groups to one."""
        aggs = []
        for n, (_, call, _) in enumerate(self.items):
            name = ag.ALIASES.get(call.name, call.name)
            name = ag.CONDITIONAL.get(name, name)
            for k in range(2 if name == "avg" else 1):
                c = F.col(f"s{n}_{k}")
                if name in ("count", "countif", "sum", "avg"):
                    m = F.sum(c)
                elif name in ("min", "max"):
                    m = (F.min if name == "min" else F.max)(c)
                elif name in ("arg_max", "arg_min"):
                    m = (F.max_by if name == "arg_max" else F.min_by)(c, c["r"])
                elif name == "any":
                    m = F.first(c, True)
                elif name == "dcount":
                    m = F.array_distinct(F.flatten(F.collect_list(c)))
                else:
                    m = F.array_sort(F.flatten(F.collect_list(c)))
                aggs.append(m.alias(f"s{n}_{k}"))
        keys = [c for c in states.columns if c.startswith("k")]
        return states.groupBy(*keys).agg(*aggs) if keys else states.agg(*aggs)

    def shown(self, states: DataFrame) -> Frame:
        out: dict[str, Typed] = {}
        source = self.scope.apply(Frame(self.scope.spark.createDataFrame([], _schema(self.source_types)), self.source_types), self.query.ops[:-1])
        bind = self.scope.binder(source)
        for n, (title, call, _) in enumerate(self.items):
            name = ag.ALIASES.get(call.name, call.name)
            name = ag.CONDITIONAL.get(name, name)
            c = F.col(f"s{n}_0")
            arg = bind(call.args[0]).type if call.args else "long"
            if name in ("count", "countif"):
                x = Typed(c, "long")
            elif name == "sum":
                x = Typed(c, "real")
            elif name == "avg":
                x = Typed(F.try_divide(c, F.col(f"s{n}_1")), "real")
            elif name in ("min", "max", "any"):
                x = Typed(c, arg)
            elif name in ("arg_max", "arg_min"):
                x = Typed(c["v"], bind(call.args[1]).type)
            elif name == "dcount":
                x = Typed(F.size(c).cast("bigint"), "long")
            else:
                values = F.transform(c, lambda e: e["v"])
                if name == "make_bag":
                    maps = F.transform(values, ag.bag_map)
                    x = Typed(ag.map_json(F.aggregate(maps, F.create_map().cast("map<string,string>"), lambda a, b: ag.merge_maps(b, a))), "dynamic")
                else:
                    x = Typed(ag.json_array(F.array_distinct(values) if name == "make_set" else values), "dynamic")
            out[title] = x
        for n, (title, x) in enumerate(self.by.items()):
            out[title] = Typed(F.col(f"k{n}"), x.type)
        return Frame(states.select(*[x.col.alias(n) for n, x in out.items()]), {n: x.type for n, x in out.items()})


def _schema(types: dict[str, str]):
    from ..sources.tables import spark_schema

    return spark_schema(types)


def definition(engine, name: str) -> dict | None:
    return engine.catalog.load(f"_views/{name}/view.json") if engine.catalog else None


def plan(engine, name: str) -> Plan:
    d = definition(engine, name)
    return Plan(engine, d["query"], engine.catalog.read(d["table"]))


#: Versions of a view's states that stay for readers that began before a merge.
KEEP = 4


def _store(engine, name: str, states: DataFrame, marks: dict | None = None) -> None:
    """Writes the states to a new folder and points the definition at it, so readers see the old or the new.

    ``marks`` goes into the same small file: what the states hold is known with them.
    """
    import uuid

    d = definition(engine, name)
    path = f"{engine.catalog.root}/_views/{name}/{uuid.uuid4().hex}"
    states.write.parquet(path)
    old = [*d.get("old", []), *([d["states"]] if d.get("states") else [])]
    engine.catalog.save(f"_views/{name}/view.json", d | (marks or {}) | {"states": path, "old": old[-KEEP:]})
    for gone in old[:-KEEP]:
        engine.catalog.delete(gone[len(engine.catalog.root) + 1 :])


def create(engine, name: str, table: str, text: str) -> None:
    source = engine.catalog.read(table)
    if source is None:
        raise QueryError(f"unknown table {table}")
    if checked(text).source.args["name"] != table:
        raise QueryError("the query must read the view's table")
    engine.catalog.save(f"_views/{name}/view.json", {"name": name, "table": table, "query": text})
    _store(engine, name, Plan(engine, text, source).states(source))


def names(engine) -> list[str]:
    if not engine.catalog or not engine.catalog.exists("_views"):
        return []
    listed = engine.catalog._fs("_views").listStatus(engine.catalog._path("_views"))
    return sorted(s.getPath().getName() for s in listed if engine.catalog.exists(f"_views/{s.getPath().getName()}/view.json"))


def absorb(engine, name: str, rows: Frame, source: str | None = None, batch: int | None = None) -> None:
    """Merges new rows of the table into a view.  A batch of a source that is in the states already is skipped."""
    p, d = plan(engine, name), definition(engine, name)
    batches = d.get("batches", {})
    if source is not None and batch is not None:
        if batch <= batches.get(source, -1):
            return
        batches = batches | {source: batch}
    new = p.states(rows)
    old = engine.spark.read.schema(new.schema).parquet(d["states"])
    _store(engine, name, p.merge(old.unionByName(new)), {"batches": batches})


def after_append(engine, table: str, rows: Frame) -> None:
    for name in names(engine):
        d = definition(engine, name)
        if d["table"] == table and not d.get("followed"):  # a stream brings its rows
            absorb(engine, name, rows)


def read_view(engine, name: str) -> Frame | None:
    d = definition(engine, name)
    if d is None:
        return None
    return plan(engine, name).shown(engine.spark.read.parquet(d["states"]))


def follow(engine, name: str, checkpoint: str, once: bool = True):
    """A streaming query that merges each new file of the table into the view; the checkpoint says which are in.

    A batch that comes again after a restart is known by its number and skipped.
    From then on appends reach the view by the stream alone.
    """
    d = definition(engine, name)
    engine.catalog.save(f"_views/{name}/view.json", d | {"followed": True})
    types = engine.catalog.schema(d["table"])
    stream = engine.spark.readStream.schema(_schema(types)).parquet(f"{engine.catalog.root}/{d['table']}/data")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, k: absorb(engine, name, from_spark(rows, types), checkpoint, k))
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(stream: DataFrame, moment: str, width: str, late: str, aggs: list[Column], by: list[str] | None = None, slide: str | None = None) -> DataFrame:
    """Event-time windows over a stream with a watermark: tumbling, or sliding with ``slide``."""
    window = F.window(ref(moment), width, slide) if slide else F.window(ref(moment), width)
    return stream.withWatermark(moment, late).groupBy(window, *map(ref, by or [])).agg(*aggs)
