"""The engine: statements in, frames out."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lang import tree as t
from .lang.lexer import QueryError
from .lang.parser import Parser, parse_let, parse_query, split_statements
from .operators import OPERATORS
from .operators.graph import Graph
from .operators.nested import bag_unpack
from .operators.relational import unite
from .functions.registry import json_object
from .plans import typed as ty
from .plans.expr import Binder
from .plans.frame import Frame, from_spark, ref
from .plans.typed import Typed, as_json
from .sources.files import FILES
from .sources.tables import RECEIVED, Catalog, spark_schema

MOST_DEPTH, LISTED = 64, 10_000


class Scope:
    """Names that a query sees: let bindings, functions, and tables bound by ``as``; outer scopes follow."""

    def __init__(self, engine: Engine, parent: Scope | None = None):
        self.engine, self.parent, self.spark = engine, parent, engine.spark
        self.scalars: dict[str, Typed] = {}
        self.tables: dict[str, Frame] = {}
        self.own: dict[str, t.Function] = {}
        self.depth = parent.depth + 1 if parent else 0
        self.subqueries: dict[str, list[Typed]] = {}
        if self.depth > MOST_DEPTH:
            raise QueryError("functions are nested too deep")

    def chain(self) -> Iterable[Scope]:
        at: Scope | None = self
        while at:
            yield at
            at = at.parent

    def scalar(self, name: str) -> Typed | None:
        return next((s.scalars[name] for s in self.chain() if name in s.scalars), None)

    def functions(self) -> dict[str, t.Function]:
        out: dict[str, t.Function] = {}
        for s in self.chain():
            out = s.own | out
        return out

    def binder(self, frame: Frame) -> Binder:
        return Binder(frame.names, self)

    # -- constants
    def number(self, col):
        """The value of an expression without columns, folded by Spark."""
        return self.spark.range(1).select(col.alias("x")).first()[0]

    def folded(self, x: Typed) -> Typed:
        return x if x.const else Typed(x.col, x.type, self.number(x.col), True)

    # -- subqueries
    def _listed(self, query, text: str) -> list[Typed]:
        key = text or repr(query)
        if key not in self.subqueries:
            frame = self.query(query)
            name, kind = next(iter(frame.types.items()))
            rows = frame.df.select(ref(name)).limit(LISTED + 1).collect()
            if len(rows) > LISTED:
                raise QueryError(f"a list of over {LISTED} values may only stand alone in where")
            self.subqueries[key] = [ty.literal(r[0], kind) if kind != "datetime" else Typed(F.lit(r[0]), kind, r[0], True) for r in rows]
        return self.subqueries[key]

    def first_column(self, e) -> list[Typed]:
        query = e.query if isinstance(e, t.Sub) else t.Query(t.Op("table", {"name": e.name}), [])
        return self._listed(query, e.text if isinstance(e, t.Sub) else e.name)

    def first_cell(self, query: t.Query) -> Typed:
        frame = self.query(query)
        name, kind = next(iter(frame.types.items()))
        from .operators.relational import first_rows

        row = first_rows(frame, 1).df.select(ref(name)).first()
        value = row[0] if row else None
        return Typed(F.lit(value).cast(ty.SPARK[kind]), kind, value, True)

    def semi_joins(self, frame: Frame, e):
        """Turns ``x in (query)`` conjuncts into semi and anti joins; what is left of the condition goes on."""
        if isinstance(e, t.Binary) and e.op == "and":
            frame, a = self.semi_joins(frame, e.left)
            frame, b = self.semi_joins(frame, e.right)
            return frame, a if b is None else b if a is None else t.Binary("and", a, b)
        if isinstance(e, t.In) and e.op in ("in", "!in", "in~", "!in~") and len(e.items) == 1:
            item = e.items[0]
            table = isinstance(item, t.Name) and item.name not in frame.types and self.scalar(item.name) is None
            if isinstance(item, t.Sub) or table:
                query = item.query if isinstance(item, t.Sub) else t.Query(t.Op("table", {"name": item.name}), [])
                other = self.query(query)
                name, kind = next(iter(other.types.items()))
                left, right = self.binder(frame)(e.left), Typed(ref(name), kind)
                low = F.lower if e.op.endswith("~") else lambda c: c
                a, b = (left.col, right.col) if left.type == right.type and left.type != "dynamic" and low is not F.lower else (low(ty.text(left)), low(ty.text(right)))
                right_df = other.df.select(b.alias("__key")).filter(F.col("__key").isNotNull())
                df = frame.df.withColumn("__left", a)
                if e.op[0] == "!":
                    df = df.filter(F.col("__left").isNotNull()).join(right_df, F.col("__left") == F.col("__key"), "left_anti")
                else:
                    df = df.join(right_df, F.col("__left") == F.col("__key"), "left_semi")
                return frame.with_df(df.drop("__left")), None
        return frame, e

    # -- functions
    def call_scalar(self, f: t.Function, args: list[Typed], caller: Binder) -> Typed:
        inner = Scope(self.engine, self)
        inner.own = {n: g for n, g in self.functions().items() if g is not f}
        for i, (name, kind, default) in enumerate(f.params):
            if i >= len(args) and default is None:
                raise QueryError(f"argument {name} is missing")
            inner.scalars[name] = ty.cast(args[i] if i < len(args) else Binder({}, self)(default), kind)
        *lets, body = split_statements(f.body)
        for let in lets:
            inner.let(parse_let(let))
        p = Parser(body)
        return Binder({}, inner)(p.expr())

    def call_tabular(self, name: str, args: list, piped: Frame | None = None) -> Frame:
        """A function with a tabular body; a piped table is its first argument."""
        found = next((f for n, f in self.functions().items() if n.lower() == name.lower()), None) or self.engine.stored_function(name)
        if found is None:
            raise QueryError(f"unknown function {name}")
        inner = Scope(self.engine, self)
        inner.own = {n: g for n, g in self.functions().items() if g is not found}
        if name.lower() in self.engine.running:
            raise QueryError(f"function {name} calls itself")
        values = ([piped] if piped is not None else []) + list(args)
        for i, (param, kind, default) in enumerate(found.params):
            if isinstance(kind, list):
                if i >= len(values):
                    raise QueryError(f"argument {param} is missing")
                v = values[i]
                frame = v if isinstance(v, Frame) else self.query(v.query if isinstance(v, t.Sub) else t.Query(t.Op("table", {"name": v.name}), []))
                for n, k in kind:
                    if n not in frame.types:
                        raise QueryError(f"{param} has no column {n}")
                    if frame.types[n] != k and not (k == "real" and frame.types[n] in ("long", "int")):
                        raise QueryError(f"column {n} of {param} is {frame.types[n]}, not {k}")
                inner.tables[param] = frame
            else:
                given = values[i] if i < len(values) else default
                if given is None:
                    raise QueryError(f"argument {param} is missing")
                inner.scalars[param] = ty.cast(Binder({}, self)(given), kind)
        self.engine.running.add(name.lower())
        try:
            *lets, body = split_statements(found.body)
            for let in lets:
                inner.let(parse_let(let))
            return inner.query(parse_query(body))
        finally:
            self.engine.running.discard(name.lower())

    def let(self, let: t.Let) -> None:
        if isinstance(let.value, t.Function):
            self.own[let.name] = let.value
        elif isinstance(let.value, t.Query):
            self.tables[let.name] = self.query(let.value)
        elif isinstance(let.value, t.Name) and self.scalar(let.value.name) is None:
            self.tables[let.name] = self.table(let.value.name)
        elif isinstance(let.value, t.Call) and let.value.name not in Binder({}, self).scope.functions() and self.engine.is_tabular(let.value.name):
            self.tables[let.name] = self.query(t.Query(t.Op("call", {"name": let.value.name, "args": list(let.value.args)}), []))
        else:
            self.scalars[let.name] = Binder({}, self)(let.value)

    # -- tables
    def table(self, name: str) -> Frame:
        for s in self.chain():
            if name in s.tables:
                return s.tables[name]
        found = self.engine.table(name)
        if found is None:
            if any(n.lower() == name.lower() for n in self.functions()) or self.engine.stored_function(name):
                return self.call_tabular(name, [])
            raise QueryError(f"unknown table {name}")
        return found

    def query(self, q: t.Query) -> Frame:
        frame = SOURCES[q.source.kind](self, q.source.args)
        if q.source.kind == "table" and RECEIVED in frame.types and RECEIVED not in repr(q.ops):
            frame = Frame(frame.df, {n: k for n, k in frame.types.items() if n != RECEIVED}, frame.keys, frame.order)
            frame = frame.select(frame.names).with_df(frame.visible())
        out = self.apply(frame, q.ops)
        if isinstance(out, Graph):
            raise QueryError("a graph needs graph-match or graph-to-table")
        return out

    def apply(self, frame, ops: list[t.Op]):
        for op in ops:
            if isinstance(frame, Graph) != (op.kind in ("graph-match", "graph-to-table")):
                raise QueryError(f"{op.kind} cannot follow here")
            frame = OPERATORS[op.kind](self, frame, op)
        return frame


# -- sources


def _print(scope: Scope, a) -> Frame:
    bind, out = Binder({}, scope), {}
    for i, item in enumerate(a["items"]):
        x = bind(item.expr)
        name = item.name or (item.expr.name if isinstance(item.expr, t.Name) else f"print_{i}")
        out[name] = ty.cast(x, "string") if x.type == "null" else x
    df = scope.spark.range(1).select(*[x.col.alias(n) for n, x in out.items()])
    return Frame(df, {n: x.type for n, x in out.items()})


def _range(scope: Scope, a) -> Frame:
    bind = Binder({}, scope)
    low, high, step = (scope.folded(bind(a[k])) for k in ("low", "high", "step"))
    name = a["name"]
    if not step.value:
        raise QueryError("range needs a step other than 0")
    if low.type == "datetime":
        us = [scope.number(ty.micros(low.col)), scope.number(ty.micros(high.col)), int(step.value) // 10]
        df = scope.spark.range(us[0], us[1] + (1 if us[2] > 0 else -1), us[2]).select(F.timestamp_micros("id").alias(name))
        return Frame(df, {name: "datetime"}, order=((name, us[2] > 0),))
    if "real" in (low.type, high.type, step.type):
        n = int((high.value - low.value) / step.value + 1e-9)
        df = scope.spark.range(0, max(0, n + 1)).select((F.lit(float(low.value)) + F.col("id") * F.lit(float(step.value))).alias(name))
        return Frame(df, {name: "real"}, order=((name, step.value > 0),))
    up = step.value > 0
    df = scope.spark.range(low.value, high.value + (1 if up else -1), step.value).select(F.col("id").alias(name))
    return Frame(df, {name: "timespan" if low.type == "timespan" else "long"}, order=((name, up),))


def _datatable(scope: Scope, a) -> Frame:
    schema, values = a["schema"], a["values"]
    bind, width = Binder({}, scope), len(schema)
    types = dict(schema)
    rows = []
    for i in range(0, len(values), width):
        row = []
        for (_, kind), e in zip(schema, values[i : i + width]):
            x = bind(e)
            if kind == "dynamic" and x.const:
                row.append(None if x.value is None else x.value if x.type == "string" else ty.canonical(x.value))
            elif kind == x.type and x.const:
                row.append(x.value)
            elif x.const and x.value is None:
                row.append(None)
            elif kind == "real" and x.const and isinstance(x.value, (int, float)):
                row.append(float(x.value))
            else:
                row.append(scope.number(ty.cast(x, kind).col))
        rows.append(tuple(row + [None] * (width - len(row))))
    return Frame(scope.spark.createDataFrame(rows, spark_schema(types)).coalesce(1), types)


def _matcher(term: str):
    """A search term with * at its ends."""
    from .plans.expr import has_term

    if term == "*":
        return lambda c: F.lit(True)
    start, end, word = term.startswith("*"), term.endswith("*"), ty.literal(term.strip("*"), "string")
    if start and end:
        return lambda c: F.contains(F.lower(c), F.lower(word.col))
    return lambda c: has_term(c, word, before=not start, after=not end)


def _search(scope: Scope, a) -> Frame:
    test, out = _matcher(str(a["term"])), None
    for name in a["tables"] or scope.engine.table_names():
        f = scope.table(name)
        texts = [n for n, k in f.types.items() if k in ("string", "guid", "dynamic")]
        if not texts:
            continue
        key = ty.text(next(iter(f.names.values())))
        hits = F.array(*[F.struct(F.lit(n).alias("Column"), ref(n).alias("Value")) for n in texts])
        df = f.df.select(F.lit(name).alias("TableName"), key.alias("RowKey"), F.explode(F.filter(hits, lambda h: F.coalesce(test(h["Value"]), F.lit(False)))).alias("h"))
        df = df.select("TableName", "h.Column", "RowKey", "h.Value")
        out = df if out is None else out.unionByName(df)
    types = {"TableName": "string", "Column": "string", "RowKey": "string", "Value": "string"}
    return Frame(out if out is not None else scope.spark.createDataFrame([], spark_schema(types)), types)


def _find(scope: Scope, a) -> Frame:
    from .operators.graph import variables

    frames = {n: scope.table(n) for n in a["tables"] or scope.engine.table_names()}
    where = a["where"]
    if isinstance(where, t.Lit) and where.type == "string":
        where = t.Binary("has", t.Star(), where)
    named = variables(where)
    frames = {n: f for n, f in frames.items() if not named or named & set(f.types)}
    if not frames:
        raise QueryError("find: no table has these columns")
    every = [set(f.types) for f in frames.values()]
    common = [n for n in next(iter(frames.values())).types if all(n in s for s in every)]
    parts = []
    for name, f in frames.items():
        missing = {n: ty.literal(None, "string") for n in named - set(f.types) if scope.scalar(n) is None}
        names = f.names | {n: Typed(x.col, "null") for n, x in missing.items()}
        df = f.df.filter(Binder(f.names, scope).predicate(where) if isinstance(where, t.Binary) and isinstance(where.left, t.Star) else Binder(names, scope).predicate(where))
        out = {a["source"]: ty.literal(name, "string")}
        pack = lambda left: Typed(json_object([(n, as_json(f.names[n])) for n in left]) if left else F.lit("{}"), "dynamic")
        if a["columns"]:
            asked = [n for n, _ in a["columns"]]
            for n, k in a["columns"]:
                if k == "*pack":
                    out["pack_"] = pack([c for c in f.types if c not in asked])
                elif n in f.types:
                    out[n] = ty.cast(f.names[n], k) if k else f.names[n]
                else:
                    out[n] = ty.literal(None, k or next((g.types[n] for g in frames.values() if n in g.types), "string"))
        else:
            out |= {n: f.names[n] for n in common}
            out["pack_"] = pack([n for n in f.types if n not in common])
        parts.append(Frame(df.select(*[x.col.alias(n) for n, x in out.items()]), {n: x.type for n, x in out.items()}))
    return unite(parts)


def _call(scope: Scope, a) -> Frame:
    name, args = a["name"], a["args"]
    if name.lower() in FILES:
        return FILES[name.lower()](scope.spark, str(Binder({}, scope)(args[0]).value))
    if scope.engine.resolver:
        found = scope.engine.resolver(name, [getattr(x, "text", "") for x in args])
        if found is not None:
            return from_spark(found)
    return scope.call_tabular(name, args)


SOURCES: dict[str, Callable[[Scope, dict], Frame]] = {
    "table": lambda s, a: s.table(a["name"]),
    "query": lambda s, a: s.query(a["query"]),
    "union": lambda s, a: unite([s.query(q) for q in a["parts"]]),
    "print": _print,
    "range": _range,
    "datatable": _datatable,
    "search": _search,
    "find": _find,
    "call": _call,
    "database": lambda s, a: s.engine.federated(a["alias"], a["table"]),
}


class Engine:
    """Runs query text over registered frames, Parquet files and a catalog of stored tables.

    ``resolver(name, argument texts)`` may give a DataFrame for a call; ``aliases``
    maps names of other catalogs to their roots.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, aliases: dict[str, str] | None = None, resolver: Callable | None = None):
        self.spark = spark.newSession()
        for key, value in {"spark.sql.caseSensitive": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"}.items():
            self.spark.conf.set(key, value)
        for key in ("spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
            if (value := spark.conf.get(key, None)) is not None and key.startswith("spark.sql"):
                self.spark.conf.set(key, value)
        self.catalog = Catalog(self.spark, root) if root else None
        self.aliases, self.resolver = aliases or {}, resolver
        self.frames: dict[str, Callable[[], Frame]] = {}
        self.plugins: dict[str, Callable] = {"bag_unpack": bag_unpack}
        self.running: set[str] = set()
        self.written: list[Callable[[str, DataFrame], None]] = []

    # -- tables
    def register(self, name: str, df: DataFrame, types: dict[str, str] | None = None) -> None:
        self.frames[name] = lambda: from_spark(df, types)

    def register_parquet(self, name: str, path: str, types: dict[str, str] | None = None) -> None:
        self.frames[name] = lambda: from_spark(self.spark.read.parquet(path), types)

    def table(self, name: str) -> Frame | None:
        if name in self.frames:
            return self.frames[name]()
        if self.catalog:
            from .streaming.views import read_view

            return self.catalog.read(name) or read_view(self, name)
        return None

    def table_names(self) -> list[str]:
        return sorted({*self.frames, *(self.catalog.tables() if self.catalog else ())})

    def federated(self, alias: str, table: str) -> Frame:
        if alias not in self.aliases:
            raise QueryError(f"unknown database {alias}")
        found = Catalog(self.spark, self.aliases[alias]).read(table)
        if found is None:
            raise QueryError(f"unknown table {table}")
        return Frame(found.df, found.types)

    def stored_function(self, name: str) -> t.Function | None:
        from .plans.commands import load_function

        return load_function(self, name) if self.catalog else None

    def is_tabular(self, name: str) -> bool:
        return name in FILES or self.stored_function(name) is not None

    # -- statements
    def frame(self, text: str) -> Frame:
        """The result of a script; of several statements the last."""
        from .plans import commands

        scope, out = Scope(self), None
        for statement in split_statements(text):
            if statement.startswith("."):
                out = commands.run(self, scope, statement)
            elif statement.split(None, 1)[0] == "let":
                scope.let(parse_let(statement))
            else:
                out = scope.query(parse_query(statement))
        if out is None:
            raise QueryError("nothing to run")
        return out

    def query(self, text: str) -> DataFrame:
        """The result as a DataFrame: sorted if the query's last word on order is a sort."""
        frame = self.frame(text)
        df = frame.df.orderBy(*frame.sort_columns()) if frame.order else frame.df
        return df.select(*map(ref, frame.types))
