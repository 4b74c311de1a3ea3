"""Management commands: statements that begin with a dot."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from ..functions.registry import in_pandas
from ..lang import tree as t
from ..lang.lexer import QueryError
from ..lang.parser import Parser, parse_params, parse_query
from ..sources.files import typed_texts
from ..sources.tables import RECEIVED
from ..streaming import views
from . import typed as ty
from .frame import Frame, from_spark, ref

HELP = {
    ".create table T (C:type, ...)": "creates a table",
    ".create-merge table T (C:type, ...)": "creates a table or adds columns",
    ".drop table T": "sets a table aside",
    ".show tables": "lists tables",
    ".show table T extents": "lists a table's files",
    ".ingest inline into table T <| rows": "adds rows of CSV text",
    ".ingest csv into table T from \"path\"": "adds rows of a CSV file",
    ".set T <| query": "creates a table from a query",
    ".set-or-append T <| query": "adds a query's rows",
    ".create function F(params) { body }": "stores a function",
    ".create materialized-view V on table T { query }": "stores a view",
    ".compact table T": "rewrites a table's files",
    ".gc table T": "deletes what compaction left",
}
NAME = r"(?:\['([^']+)'\]|([A-Za-z_]\w*))"


def _name(m: re.Match, k: int = 1) -> str:
    return m.group(k) or m.group(k + 1)


def listed(engine, types: dict[str, str], rows: list[tuple]) -> Frame:
    from ..sources.tables import spark_schema

    return Frame(engine.spark.createDataFrame(rows, spark_schema(types)), types)


def done(engine, text: str) -> Frame:
    return listed(engine, {"Result": "string"}, [(text,)])


def _need(engine) -> None:
    if engine.catalog is None:
        raise QueryError("this engine has no catalog; give it a root")


def load_function(engine, name: str) -> t.Function | None:
    found = next((f for f in functions(engine) if f["name"].lower() == name.lower()), None)
    if not found:
        return None
    p = Parser(found["params"] + ")")
    return t.Function(parse_params(p), found["body"])


def functions(engine) -> list[dict]:
    return (engine.catalog.load("_functions.json") or []) if engine.catalog else []


def run(engine, scope, text: str) -> Frame:
    command, tail = text, ""
    if text.startswith(".show"):
        command, _, tail = text.partition("|")
    for pattern, action in COMMANDS:
        if m := re.fullmatch(pattern, command.strip(), re.S | re.I):
            if action is not _help:
                _need(engine)
            out = action(engine, scope, m)
            return scope.apply(out, parse_query("T |" + tail).ops) if tail else out
    raise QueryError(f"unknown command {text.split()[0]}")


def _columns(text: str) -> dict[str, str]:
    return dict(Parser(text + ")").schema())


def _create_table(engine, scope, m):
    engine.catalog.create(_name(m), _columns(m.group(3)), not re.search(r"notimereceived\s*=\s*true", m.group(4) or "", re.I))
    return done(engine, f"table {_name(m)} created")


def _merge_table(engine, scope, m):
    engine.catalog.merge(_name(m), _columns(m.group(3)))
    return done(engine, f"table {_name(m)} merged")


def _drop_table(engine, scope, m):
    engine.catalog.drop(_name(m))
    return done(engine, f"table {_name(m)} dropped")


def _drop_extent(engine, scope, m):
    for table in engine.catalog.tables():
        if any(n == m.group(1) for n, _ in engine.catalog.extents(table)):
            engine.catalog.delete(f"{table}/data/{m.group(1)}")
            return done(engine, f"extent {m.group(1)} dropped")
    raise QueryError(f"unknown extent {m.group(1)}")


def _show_tables(engine, scope, m):
    return listed(engine, {"TableName": "string", "Columns": "long", "Extents": "long"}, [(n, len(engine.catalog.schema(n)), len(engine.catalog.extents(n))) for n in engine.catalog.tables()])


def _show_extents(engine, scope, m):
    return listed(engine, {"ExtentId": "string", "Size": "long"}, engine.catalog.extents(_name(m)))


def _show_database(engine, scope, m):
    return listed(engine, {"Root": "string", "Tables": "long", "Functions": "long", "Views": "long"}, [(engine.catalog.root, len(engine.catalog.tables()), len(functions(engine)), len(views.names(engine)))])


def _typed_rows(engine, name: str, lines, header: bool | None) -> Frame:
    """CSV records for a table: by position, or by name if at least half of the first record are its columns."""
    types = {n: k for n, k in engine.catalog.schema(name).items() if n != RECEIVED}
    reader = engine.spark.read.option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    first = reader.csv(lines).limit(1).collect()
    cells = [c or "" for c in first[0]] if first else []
    if header is None and sum(c in types for c in cells) * 2 >= max(1, len(cells)):
        if sorted(cells) != sorted(types):
            raise QueryError("the header is no permutation of the table's columns")
        df = reader.option("header", True).csv(lines)
        order = cells
    else:
        df, order = reader.csv(lines), list(types)
        if cells and len(cells) != len(order):
            raise QueryError(f"{len(cells)} columns for {len(order)}")
    df = df.toDF(*order[: len(df.columns)]) if df.columns else df
    frame = typed_texts(df, types)
    bad = F.lit(False)
    for n, k in types.items():
        if k != "string":
            bad = bad | (ref(n).isNull() & (F.coalesce(F.col("__raw")[n], F.lit("")) != "") & (F.col("__raw")[n] != "null"))
    raw = df.withColumn("__raw", F.struct(*[ref(n) for n in df.columns]))
    checked = raw.select(*[ty.cast(ty.Typed(F.nullif(ref(n), F.lit("")) if types[n] != "string" else ref(n), "string"), types[n]).col.alias(n) for n in df.columns], "__raw")
    if checked.filter(bad).take(1):
        raise QueryError("a value does not fit its column; nothing was added")
    return frame


def _ingest_inline(engine, scope, m):
    rows = [r for r in m.group(3).strip().splitlines() if r.strip()]
    lines = engine.spark.createDataFrame([(r,) for r in rows], "value string").coalesce(1)
    types = {n: k for n, k in engine.catalog.schema(_name(m)).items() if n != RECEIVED}
    schema = ", ".join(f"`{n}` string" for n in types)
    df = lines.select(F.from_csv("value", schema, {"escape": '"'}).alias("r")).select("r.*")
    engine.catalog.append(_name(m), typed_texts(df, types))
    return done(engine, f"{len(rows)} rows added")


def _ingest_csv(engine, scope, m):
    frame = _typed_rows(engine, _name(m), m.group(3), None)
    engine.catalog.append(_name(m), frame)
    return done(engine, "rows added")


def _set(engine, scope, m):
    name, frame = _name(m), scope.query(parse_query(m.group(3)))
    engine.catalog.create(name, frame.types)
    engine.catalog.append(name, frame)
    return done(engine, f"table {name} created")


def _append(engine, scope, m):
    name, frame = _name(m), scope.query(parse_query(m.group(3)))
    types = engine.catalog.schema(name)
    if types is None:
        return _set(engine, scope, m)
    if missing := [n for n in types if n not in frame.types and n != RECEIVED]:
        raise QueryError(f"the query has no column {missing[0]}")
    # The rows are written once and read again, so the table and its views get the same.
    from ..sources.tables import scratch

    frame = Frame(scratch(frame.visible()), frame.types)
    rows = engine.catalog.append(name, frame)
    views.after_append(engine, name, Frame(rows, types))
    return done(engine, f"rows added to {name}")


def _embed(engine, scope, m):
    """Texts of a query with their embeddings."""
    from ..functions import registry

    name, frame = _name(m), scope.query(parse_query(m.group(3)))
    for n in ("Id", "Text"):
        if n not in frame.types:
            raise QueryError(f"the query has no column {n}")
    names = frame.names
    out = {"Id": names["Id"], "Text": names["Text"], "Embedding": registry.FUNCTIONS["embed_text"](names["Text"])}
    out |= {n: names[n] for n in ("Model", "Provenance") if n in names}
    made = frame.select(out)
    if engine.catalog.schema(name) is None:
        engine.catalog.create(name, made.types)
    engine.catalog.append(name, made)
    return done(engine, f"embeddings added to {name}")


def chunks(text: str, most: int = 1500) -> list[tuple[str, str, int, int]]:
    """Paragraphs of a Markdown text up to ``most`` characters: text, headings above, first and last line."""
    out, trail, block, start = [], [], [], 1

    def close(end: int) -> None:
        if body := "\n".join(block).strip():
            out.append((body, " > ".join(h for _, h in trail), start, end))
        block.clear()

    for n, line in enumerate([*text.splitlines(), ""], 1):
        heading = re.match(r"(#{1,6})\s+(.*)", line)
        if heading:
            close(n - 1)
            trail = [(d, h) for d, h in trail if d < len(heading.group(1))] + [(len(heading.group(1)), heading.group(2).strip())]
        elif not line.strip() or block and sum(map(len, block)) + len(line) > most:
            close(n - 1)
            if line.strip():
                block.append(line)
                start = n
        else:
            if not block:
                start = n
            block.append(line)
    return out


def _chunk(engine, scope, m):
    import json

    path, name = m.group(1), m.group(2) or m.group(3)
    made = lambda s: json.dumps([{"b": b, "h": h, "s": s0, "e": e} for b, h, s0, e in chunks(s or "")], ensure_ascii=False)
    df = engine.spark.read.text(path, wholetext=True)
    df = df.select(F.posexplode(F.from_json(in_pandas(made, "string", F.col("value")), "array<struct<b:string,h:string,s:long,e:long>>")).alias("i", "c"))
    df = df.select(F.concat(F.lit(path + "#"), F.col("i").cast("string")).alias("Id"), F.col("c.b").alias("Text"), F.col("c.h").alias("HeadingTrail"), F.col("c.s").alias("StartLine"), F.col("c.e").alias("EndLine"), F.lit(path).alias("Provenance"))
    frame = from_spark(df)
    if engine.catalog.schema(name) is None:
        engine.catalog.create(name, frame.types)
    engine.catalog.append(name, frame)
    return done(engine, f"chunks added to {name}")


def _create_function(engine, scope, m):
    name = m.group("name")
    old = functions(engine)
    exists = any(f["name"].lower() == name.lower() for f in old)
    if exists and m.group("skip"):
        return done(engine, f"function {name} exists")
    if exists and not m.group("alter"):
        raise QueryError(f"function {name} exists")
    parse_params(Parser(m.group("params") + ")"))
    options = dict(re.findall(r"(\w+)\s*=\s*[\"']([^\"']*)[\"']", m.group("with") or ""))
    new = {"name": name, "params": m.group("params"), "body": m.group("body").strip(), "docstring": options.get("docstring", ""), "folder": options.get("folder", ""), "at": time.time()}
    engine.catalog.save("_functions.json", [f for f in old if f["name"].lower() != name.lower()] + [new])
    return done(engine, f"function {name} stored")


FUNCTION_TYPES = {"Name": "string", "Parameters": "string", "Body": "string", "Folder": "string", "DocString": "string"}


def _show_functions(engine, scope, m):
    rows = [(f["name"], f"({f['params']})", f["body"], f["folder"], f["docstring"]) for f in functions(engine) if not m.groups() or m.group(1) is None or f["name"].lower() == m.group(1).lower()]
    if m.groups() and m.group(1) and not rows:
        raise QueryError(f"unknown function {m.group(1)}")
    return listed(engine, FUNCTION_TYPES, rows)


def _drop_function(engine, scope, m):
    gone = {n.strip().lower() for n in m.group(1).split(",")}
    old = functions(engine)
    if missing := gone - {f["name"].lower() for f in old}:
        raise QueryError(f"unknown function {sorted(missing)[0]}")
    engine.catalog.save("_functions.json", [f for f in old if f["name"].lower() not in gone])
    return done(engine, "dropped")


def _create_view(engine, scope, m):
    name = m.group("name")
    if views.definition(engine, name):
        if m.group("skip"):
            return done(engine, f"view {name} exists")
        raise QueryError(f"view {name} exists")
    views.create(engine, name, m.group("table"), m.group("body").strip())
    return done(engine, f"view {name} created")


def _show_views(engine, scope, m):
    return listed(engine, {"Name": "string", "SourceTable": "string", "Query": "string"}, [(d["name"], d["table"], d["query"]) for d in (views.definition(engine, n) for n in views.names(engine))])


def _drop_view(engine, scope, m):
    if not views.definition(engine, m.group(1)):
        raise QueryError(f"unknown view {m.group(1)}")
    engine.catalog.delete(f"_views/{m.group(1)}")
    return done(engine, f"view {m.group(1)} dropped")


def compact(engine, scope, name: str, where: str | None = None) -> None:
    frame = engine.catalog.read(name)
    if frame is None:
        raise QueryError(f"unknown table {name}")
    df = frame.df
    if where:
        df = df.filter(scope.binder(frame).predicate(Parser(where).expr()))
    size = sum(n for _, n in engine.catalog.extents(name))
    # Files of about 128 MB.
    engine.catalog.replace(name, df.repartition(max(1, size >> 27)))


def _compact(engine, scope, m):
    for name in [_name(m)] if m.lastindex else engine.catalog.tables():
        compact(engine, scope, name, m.group(3) if m.lastindex and m.lastindex >= 3 else None)
    return done(engine, "compacted")


def _gc(engine, scope, m):
    for name in [_name(m)] if m.lastindex else engine.catalog.tables():
        engine.catalog.delete(f"{name}/.superseded")
    return done(engine, "collected")


def _help(engine, scope, m):
    return listed(engine, {"Command": "string", "Description": "string"}, list(HELP.items()))


COMMANDS = [
    (rf"\.create\s+table\s+{NAME}\s*\((.*?)\)\s*(with\s*\(.*\))?", _create_table),
    (rf"\.(?:create|alter)-merge\s+table\s+{NAME}\s*\((.*?)\)", _merge_table),
    (rf"\.drop\s+table\s+{NAME}", _drop_table),
    (r"\.drop\s+extent\s+(\S+)", _drop_extent),
    (r"\.show\s+tables", _show_tables),
    (rf"\.show\s+table\s+{NAME}\s+extents", _show_extents),
    (r"\.show\s+database", _show_database),
    (rf"\.ingest\s+inline\s+into\s+table\s+{NAME}\s*<\|(.*)", _ingest_inline),
    (rf"\.ingest\s+csv\s+into\s+table\s+{NAME}\s+from\s+[\"'](.*?)[\"']", _ingest_csv),
    (rf"\.set\s+{NAME}\s*<\|(.*)", _set),
    (rf"\.set-or-append\s+{NAME}\s*<\|(.*)", _append),
    (rf"\.embed-into\s+{NAME}\s*<\|(.*)", _embed),
    (r"\.chunk-file\s+[\"'](.*?)[\"']\s+into\s+" + NAME, _chunk),
    (r"\.create(?P<alter>-or-alter)?\s+function\s+(?P<skip>ifnotexists\s+)?(?P<with>with\s*\(.*?\)\s*)?(?P<name>\w+)\s*\((?P<params>[^{]*)\)\s*\{(?P<body>.*)\}", _create_function),
    (r"\.show\s+functions", _show_functions),
    (r"\.show\s+function\s+(\w+)", _show_functions),
    (r"\.drop\s+functions?\s+\(?([\w,\s]+?)\)?", _drop_function),
    (r"\.create\s+(?P<skip>ifnotexists\s+)?materialized-view\s+(?:with\s*\(.*?\)\s*)?(?P<name>\w+)\s+on\s+table\s+(?P<table>\w+)\s*\{(?P<body>.*)\}", _create_view),
    (r"\.show\s+materialized-views", _show_views),
    (r"\.drop\s+materialized-view\s+(\w+)", _drop_view),
    (rf"\.(?:compact|merge)\s+table\s+{NAME}(?:\s+extents)?(?:\s+where\s+(.*))?", _compact),
    (r"\.compact\s+database", _compact),
    (rf"\.gc\s+table\s+{NAME}", _gc),
    (r"\.gc\s+database", _gc),
    (r"\.help", _help),
]
