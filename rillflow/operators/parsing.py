"""parse, parse-where and parse-kv."""

from __future__ import annotations

import json
import re

from pyspark.sql import functions as F

from ..functions.registry import in_pandas
from ..plans import typed as ty
from ..plans.expr import quote
from ..plans.frame import Frame
from ..plans.typed import Typed
from . import operator

#: What a typed part of a pattern takes.
TAKES = {"long": r"\s*([+-]?\d+)\s*", "int": r"\s*([+-]?\d+)\s*", "real": r"\s*([+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*", "bool": r"\s*(true|false|0|1)\s*"}


def pattern(parts: list, mode: str, flags: str) -> tuple[str, list]:
    """One regular expression for the parts, and the columns with the group of each."""
    out, columns, group = [], [], 0
    for i, (name, value) in enumerate(parts):
        last = i == len(parts) - 1
        if name == "*":
            out.append(".*" if last else ".*?")
        elif name == "text":
            out.append(value.replace("(?P<", "(?<") if mode == "regex" else quote(value))
            group += re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", value)).groups if mode == "regex" else 0
        else:
            group += 1
            columns.append((name, value, group))
            out.append("(.*)" if last else "(.*?)" if mode == "relaxed" or value not in TAKES else TAKES[value])
    lead = "" if parts and parts[0][0] == "*" else "^"
    tail = "" if parts and parts[-1][0] == "*" else "$"
    inline = "".join(f for f in "ims" if f in flags or f == "s" and mode != "regex")
    text = (f"(?{inline})" if inline else "") + lead + "".join(out) + tail
    return text, columns


def _parse(scope, frame: Frame, op, only: bool) -> Frame:
    a = op.args
    text = ty.text(scope.binder(frame)(a["target"]))
    regex, columns = pattern(a["parts"], a["mode"], a["flags"])
    found = F.coalesce(text.rlike(regex), F.lit(False))
    values = {n: ty.cast(Typed(F.regexp_extract(text, regex, g), "string"), k) for n, k, g in columns}
    if only or a["mode"] == "relaxed":
        good = found
    else:  # a part that its type does not take spoils the whole row
        good = found
        for n, k, _ in columns:
            if k != "string":
                good = good & values[n].col.isNotNull()
    new = {n: Typed(F.when(good, x.col), x.type) for n, x in values.items()}
    out = frame.select(frame.names | new) if not only else frame.with_df(frame.df.filter(good)).select(frame.names | values)
    return out


@operator("parse")
def parse(scope, frame, op):
    return _parse(scope, frame, op, False)


@operator("parse-where")
def parse_where(scope, frame, op):
    return _parse(scope, frame, op, True)


def pairs(line: str | None, pair: str, kv: str, quotes: str, escape: str, greedy: bool) -> dict[str, str]:
    """Key and value texts; the first of equal keys wins."""
    out: dict[str, str] = {}
    if line is None:
        return out
    if greedy:
        keys = [m for m in re.finditer(r"(?:^|(?<=%s))\s*([^\s%s]+?)\s*%s" % (re.escape(pair) if pair.strip() else r"\s", re.escape(kv[0]), re.escape(kv)), line)]
        for m, following in zip(keys, [*keys[1:], None]):
            value = line[m.end() : following.start() if following else len(line)]
            out.setdefault(m.group(1), value.strip().removesuffix(pair.strip()).strip() if pair.strip() else value.strip())
        return out
    i, n = 0, len(line)
    while i < n:
        at = line.find(kv, i)
        if at < 0:
            break
        start = line.rfind(pair, i, at)
        key = line[start + len(pair) if start >= 0 else i : at].strip()
        i = at + len(kv)
        if quotes:
            while line[i : i + 1] == " ":
                i += 1
        if quotes and line[i : i + 1] and line[i] in quotes:
            close, value, i = quotes[quotes.index(line[i]) ^ 1] if len(quotes) == 2 else line[i], "", i + 1
            while i < n and line[i] != close:
                if escape and line[i] == escape and i + 1 < n:
                    i += 1
                value += line[i]
                i += 1
            i += 1
            end = line.find(pair, i)
            i = n if end < 0 else end + len(pair)
        else:
            end = line.find(pair, i)
            value, i = (line[i:], n) if end < 0 else (line[i:end], end + len(pair))
        out.setdefault(key, value)
    return out


@operator("parse-kv")
def parse_kv(scope, frame, op):
    o = op.args["options"]
    pair, kv = o.get("pair_delimiter", " "), o.get("kv_delimiter", "=")
    quotes, escape, greedy = o.get("quote", ""), o.get("escape", ""), bool(o.get("greedy", False))
    text = ty.text(scope.binder(frame)(op.args["target"]))
    new = {}
    if quotes or greedy:
        found = F.try_variant_get(F.try_parse_json(in_pandas(lambda s: json.dumps(pairs(s, pair, kv, quotes, escape, greedy), ensure_ascii=False), "string", text)), "$", "map<string,string>")
        get = lambda name: F.try_element_at(found, F.lit(name))
    else:
        parts = F.transform(F.split(text, quote(pair)), lambda p: F.struct(F.trim(F.substring_index(p, kv, 1)).alias("k"), F.when(p.contains(kv), F.substring(p, F.length(F.substring_index(p, kv, 1)) + len(kv) + 1, F.length(p))).alias("v")))
        get = lambda name: F.get(F.filter(parts, lambda p: (p["k"] == name) & p["v"].isNotNull()), F.lit(0))["v"]
    for name, kind in op.args["schema"]:
        value = get(name)
        new[name] = ty.cast(Typed(F.trim(value) if kind != "string" else value, "string"), kind)
    return frame.select(frame.names | new)
