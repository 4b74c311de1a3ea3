"""Graphs: make-graph, graph-match and graph-to-table.

A graph is a pair of frames.  A pattern is a chain of joins, one for each edge;
where-conjuncts are applied as soon as what they name is bound, so Spark joins
few rows.  Hops of variable length are unrolled joins that carry the edges used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from ..functions.registry import json_object
from ..lang import tree as t
from ..lang.lexer import QueryError
from ..sources.tables import scratch
from ..plans import typed as ty
from ..plans.expr import Binder
from ..plans.frame import Frame, ref
from ..plans.typed import Typed, as_json
from . import operator
from .relational import item_name

MOST_HOPS, MOST_MATCHES = 64, 1_000_000


@dataclass(frozen=True)
class Graph:
    nodes: Frame  # hidden column __id
    edges: Frame  # hidden columns __eid, __from, __to


@operator("make-graph")
def make_graph(scope, frame, op):
    a, b = op.args["source"], op.args["target"]
    for n in (a, b):
        if n not in frame.types:
            raise QueryError(f"unknown column {n}")
    tables = [frame.types[a], frame.types[b]]
    given = scope.query(op.args["nodes"]) if op.args["nodes"] else None
    if given is not None:
        tables.append(given.types[op.args["key"]])
    kind = tables[0] if len(set(tables)) == 1 else "string"
    id_ = lambda f, n: ty.cast(f.names[n], kind).col
    edges = frame.df.withColumn("__from", id_(frame, a)).withColumn("__to", id_(frame, b)).filter("__from is not null and __to is not null").withColumn("__eid", F.monotonically_increasing_id())
    ids = edges.select(F.col("__from").alias("__id")).union(edges.select("__to")).distinct()
    if given is None:
        nodes = Frame(ids.withColumn("NodeId", F.col("__id")), {"NodeId": kind})
    else:
        own = given.df.withColumn("__id", id_(given, op.args["key"]))
        df = ids.withColumnRenamed("__id", "__known").join(own, F.col("__known") == F.col("__id"), "full").withColumn("__id", F.coalesce("__id", "__known")).drop("__known")
        # A node that only edges name has its id and no other property.
        df = df.withColumn(op.args["key"], F.coalesce(ref(op.args["key"]), ty.cast(Typed(F.col("__id"), kind), given.types[op.args["key"]]).col))
        nodes = Frame(df.filter("__id is not null"), given.types)
    return Graph(nodes, Frame(edges, frame.types))


@operator("graph-to-table")
def graph_to_table(scope, graph, op):
    f = graph.nodes if op.args["what"] == "nodes" else graph.edges
    return Frame(f.visible(), f.types)


def conjuncts(e) -> list:
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, t.Binary) and e.op == "and" else [] if e is None else [e]


def variables(e) -> set[str]:
    """The names before a dot in an expression, and bare names."""
    if isinstance(e, t.Name):
        return {e.name}
    out: set[str] = set()
    for a in ("left", "right", "arg", "base", "low", "high", "expr"):
        if hasattr(e, a):
            out |= variables(getattr(e, a))
    for x in [*getattr(e, "args", ()), *getattr(e, "items", ())]:
        out |= variables(x)
    return out


@operator("graph-match")
def graph_match(scope, graph, op):
    a = op.args
    nodes = [n or f"__n{i}" for i, n in enumerate(a["nodes"])]
    edges = [dict(e, name=e["name"] or f"__e{i}") for i, e in enumerate(a["edges"])]
    shown = [*nodes, *(e["name"] for e in edges)]
    if len(set(shown)) != len(shown):
        raise QueryError("graph-match: a name stands twice")
    for e in edges:
        if not 1 <= e["low"] <= e["high"] <= MOST_HOPS:
            raise QueryError("graph-match: hops out of range")
    waiting = conjuncts(a["where"])
    needed = set().union(*[variables(x) for x in [*waiting, *[i.expr for i in a["items"]]]]) if waiting or a["items"] else set()
    bound: dict[str, dict[str, Typed]] = {}
    whole: dict[str, Typed] = {}

    def node(i: int):
        name = nodes[i]
        cols = [F.col("__id").alias(f"__id_{i}")]
        if name in needed:
            cols += [ref(c).alias(f"{name}.{c}") for c in graph.nodes.types]
        return graph.nodes.df.select(*cols)

    def bind_node(i: int) -> None:
        if nodes[i] in needed:
            bound[nodes[i]] = {c: Typed(ref(f"{nodes[i]}.{c}"), k) for c, k in graph.nodes.types.items()}

    def narrowed(df):
        nonlocal waiting
        ready = [x for x in waiting if all(v in bound or v in whole or v not in shown for v in variables(x))]
        waiting = [x for x in waiting if x not in ready]
        for x in ready:
            df = df.filter(Binder(whole, scope, bound).predicate(x))
        return df

    bind_node(0)
    df = narrowed(node(0))
    distinct = a["distinct"] or any(e["distinct"] for e in edges)
    if distinct and len(edges) != 1:
        raise QueryError("graph-match: distinct needs a single edge")
    df = df.withColumn("__used", F.array().cast("array<bigint>"))
    for i, e in enumerate(edges):
        name = e["name"]
        step = graph.edges.df
        record = json_object([(c, as_json(x)) for c, x in graph.edges.names.items()])
        cols = [ref(c).alias(f"{name}.{c}") for c in graph.edges.types] if name in needed and not e["many"] else []
        keep = [record.alias("__record")] if name in needed and e["many"] else []
        one = lambda x, y: step.select(F.col(x).alias("__x"), F.col(y).alias("__y"), "__eid", *cols, *keep)
        hops = one("__from", "__to") if e["way"] == "right" else one("__to", "__from") if e["way"] == "left" else one("__from", "__to").unionByName(one("__to", "__from").filter("__x <> __y"))
        at = f"__id_{i}"
        if not e["many"]:
            df = df.join(hops, F.col(at) == F.col("__x")).filter(~F.array_contains("__used", F.col("__eid")))
            df = df.withColumn("__used", F.concat("__used", F.array("__eid"))).withColumnRenamed("__y", "__next").drop("__x", "__eid")
            if name in needed:
                bound[name] = {c: Typed(ref(f"{name}.{c}"), k) for c, k in graph.edges.types.items()}
        else:
            walk = df.withColumn("__next", F.col(at)).withColumn("__path", F.array().cast("array<string>"))
            found = None
            done = None
            for depth in range(1, e["high"] + 1):
                walk = walk.join(hops.withColumnRenamed("__y", "__to2"), F.col("__next") == F.col("__x")).filter(~F.array_contains("__used", F.col("__eid")))
                walk = walk.withColumn("__used", F.concat("__used", F.array("__eid"))).withColumn("__path", F.concat("__path", F.array("__record")) if keep else F.col("__path")).withColumn("__next", F.col("__to2")).drop("__x", "__eid", "__to2", *(["__record"] if keep else []))
                if distinct:
                    # Breadth first: each node once for each start, at its smallest depth, by one of its paths.
                    row = F.struct(*[ref(c) for c in walk.columns])
                    walk = walk.groupBy(F.col(at).alias("__s"), F.col("__next").alias("__t")).agg(F.min_by(row, F.array_join(F.transform("__used", lambda u: u.cast("string")), ",")).alias("__row")).select("__row.*")
                    if done is not None:
                        walk = walk.join(done, (F.col(at) == F.col("__s")) & (F.col("__next") == F.col("__t")), "left_anti")
                    walk = scratch(walk)
                    new = walk.select(F.col(at).alias("__s"), F.col("__next").alias("__t"))
                    done = new if done is None else done.union(new)
                    if not walk.take(1):
                        break
                if depth >= e["low"]:
                    found = walk if found is None else found.unionByName(walk)
            df = found if found is not None else walk.limit(0)
            if keep:
                path = F.concat(F.lit("["), F.array_join("__path", ","), F.lit("]"))
                df = df.withColumn(f"__path_{i}", path)
                whole[name] = Typed(F.col(f"__path_{i}"), "dynamic")
            df = df.drop("__path")
        df = df.withColumnRenamed("__next", f"__id_{i + 1}")
        bind_node(i + 1)
        if nodes[i + 1] in needed:
            df = df.join(node(i + 1).withColumnRenamed(f"__id_{i + 1}", "__own"), F.col(f"__id_{i + 1}") == F.col("__own")).drop("__own")
        df = narrowed(df)
    bind = Binder(whole, scope, bound)
    out = {}
    for item in a["items"]:
        x = bind(item.expr)
        out[item_name(item)] = x
    return Frame(df.select(*[x.col.alias(n) for n, x in out.items()]), {n: x.type for n, x in out.items()})

