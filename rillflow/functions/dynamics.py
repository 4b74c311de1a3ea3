"""Arrays, property bags and JSON."""

from __future__ import annotations

import csv
import io
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import typed as ty
from ..plans.typed import Typed, as_json, text
from .registry import array, boolean, dynamic, function, in_pandas, json_array, json_object, json_text, let, listed, long, string, texts


def jsons(x: Typed) -> Column:
    """The elements of a dynamic array as JSON texts."""
    return F.transform(array(x), lambda v: F.coalesce(F.to_json(v), F.lit("null"))) if x.jsons is None else x.jsons


@function("dynamic")
def dynamic_(x):
    return x if x.type == "dynamic" else dynamic(F.when(x.col.isNotNull(), as_json(x)))


@function("array_length")
def array_length(x):
    return long(F.array_size(array(x) if x.jsons is None else x.jsons))


@function("strcat_array")
def strcat_array(x, delimiter):
    return string(F.call_function("array_join", F.transform(texts(x), lambda v: F.coalesce(v, F.lit(""))), text(delimiter)))


@function("array_concat")
def array_concat(*xs):
    return listed(F.concat(*[F.coalesce(jsons(x), F.array().cast("array<string>")) for x in xs]))


@function("array_index_of")
def array_index_of(x, value):
    return long(F.array_position(texts(x), text(value)) - 1)


def _sorted(x: Typed, descending: bool):
    """By text, numbers by value where all are numbers."""
    item = lambda v: F.struct(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)).alias("t"), F.coalesce(F.to_json(v), F.lit("null")).alias("j"), (~F.schema_of_variant(v).isin("STRING", "BOOLEAN", "VOID")).alias("numeric"))
    number = lambda z: F.struct(z["t"].try_cast("double").alias("n"), z["t"].alias("t"), z["j"].alias("j"))
    by_text = lambda s: F.array_sort(F.transform(s, lambda z: F.struct(z["t"].alias("t"), z["j"].alias("j"))))
    one = lambda s: F.when(F.forall(s, lambda z: z["numeric"]), F.transform(F.array_sort(F.transform(s, number)), lambda z: z["j"])).otherwise(F.transform(by_text(s), lambda z: z["j"]))
    out = let(F.transform(array(x), item), one)
    return dynamic(json_array(F.reverse(out) if descending else out))


@function("array_sort_asc")
def array_sort_asc(x):
    return _sorted(x, False)


@function("array_sort_desc")
def array_sort_desc(x):
    return _sorted(x, True)


@function("array_reverse")
def array_reverse(x):
    return listed(F.reverse(jsons(x)))


@function("array_slice")
def array_slice(x, start, end):
    place = lambda v, n: F.when(v < 0, n + v).otherwise(v)

    def within(s: Column) -> Column:
        a, b, n = s["a"], s["b"], F.size(s["items"])
        return F.filter(s["items"], lambda _, i: (i >= F.greatest(place(a, n), F.lit(0))) & (i <= F.least(place(b, n), n - 1)))

    return listed(let(F.struct(jsons(x).alias("items"), ty.as_long(start).alias("a"), ty.as_long(end).alias("b")), within))


@function("bag_keys")
def bag_keys(x):
    return dynamic(json_array(F.transform(F.sort_array(F.json_object_keys(x.col)), json_text)))


@function("bag_has_key")
def bag_has_key(x, key):
    return boolean(F.coalesce(F.array_contains(F.json_object_keys(x.col), text(key)), F.lit(False)))


@function("pack", "bag_pack", "pack_dictionary")
def pack(*xs):
    return dynamic(json_object([(k.value if k.const and isinstance(k.value, str) and k.type == "string" else text(k), as_json(v)) for k, v in zip(xs[::2], xs[1::2])]) if xs else F.lit("{}"))


@function("pack_array")
def pack_array(*xs):
    if not xs:
        return dynamic(F.lit("[]"))
    items = F.array(*[as_json(x) for x in xs])
    plain = all(x.type in ("long", "int", "bool") for x in xs)
    nums = None
    if all(x.type in ty.NUMERIC for x in xs):
        values = [x.col.cast("double") + F.lit(0.0) for x in xs]
        broken = [F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False)) for x, v in zip(xs, values) if x.type == "real"]
        nums = F.array(*values)
        for b in broken:
            nums = F.when(~b, nums)
    return Typed(json_array(items), "dynamic", jsons=items if plain else None, nums=nums, size=len(xs) if nums is not None else None)


@function("zip")
def zip_(*xs):
    zipped = F.arrays_zip(*[jsons(x).alias(f"z{i}") for i, x in enumerate(xs)])
    return dynamic(json_array(F.transform(zipped, lambda z: json_array(F.array(*[z[f"z{i}"] for i in range(len(xs))])))))


@function("parse_csv")
def parse_csv(x):
    def first(line):
        if line is None:
            return None
        rows = list(csv.reader(io.StringIO(line)))
        return json.dumps(rows[0], ensure_ascii=False, separators=(",", ":")) if rows else None

    return dynamic(in_pandas(first, "string", text(x)))


def _shifted(x: Typed, n: Typed, default: Typed | None, sign: int):
    parts = F.struct(jsons(x).alias("items"), (ty.as_long(n) * sign).alias("k"), (as_json(default) if default is not None else F.lit("null")).alias("fill"))
    moved = lambda s: F.transform(s["items"], lambda _, i: F.coalesce(F.when(i + s["k"] >= 0, F.get(s["items"], (i + s["k"]).cast("int"))), s["fill"]))
    return dynamic(json_array(let(parts, moved)))


@function("array_shift_left")
def array_shift_left(x, n, default=None):
    return _shifted(x, n, default, 1)


@function("array_shift_right")
def array_shift_right(x, n, default=None):
    return _shifted(x, n, default, -1)


def bag_map(col: Column) -> Column:
    """A bag as a map of JSON texts."""
    v = F.try_variant_get(F.try_parse_json(col), "$", "map<string,variant>")
    return F.transform_values(v, lambda _, x: F.coalesce(F.to_json(x), F.lit("null")))


def map_json(col: Column) -> Column:
    entries = F.array_sort(F.map_entries(col))
    return F.when(col.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_text(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}")))


def merge_maps(left: Column, right: Column) -> Column:
    """The left one's value wins."""
    new = F.map_filter(right, lambda k, _: ~F.map_contains_key(left, k))
    return F.map_concat(left, new)


@function("bag_merge")
def bag_merge(*xs):
    empty = F.create_map().cast("map<string,string>")
    out = F.coalesce(bag_map(xs[0].col), empty)
    for x in xs[1:]:
        out = merge_maps(out, F.coalesce(bag_map(x.col), empty))
    return dynamic(map_json(out))


@function("bag_remove_keys")
def bag_remove_keys(x, keys):
    def without(bag, names):
        try:
            value, drop = json.loads(bag), json.loads(names)
        except (TypeError, ValueError):
            return bag
        for name in drop:
            steps = re.findall(r"[^.\[\]'\"]+", name[1:]) if isinstance(name, str) and name.startswith("$") else [name]
            at = value
            for step in steps[:-1]:
                at = at.get(step) if isinstance(at, dict) else None
            if isinstance(at, dict):
                at.pop(steps[-1], None)
        return ty.canonical(value)

    return dynamic(in_pandas(without, "string", x.col, keys.col))


def _set(how):
    def out(*xs):
        found = jsons(xs[0])
        for x in xs[1:]:
            found = how(found, jsons(x))
        return dynamic(json_array(F.array_sort(F.array_distinct(found))))

    return out


function("set_union")(_set(F.array_union))
function("set_intersect")(_set(F.array_intersect))
function("set_difference")(_set(F.array_except))


@function("treepath")
def treepath(x):
    def paths(bag):
        try:
            value = json.loads(bag)
        except (TypeError, ValueError):
            return None
        out: list[str] = []

        def walk(v, at):
            out.append(at)
            if isinstance(v, dict):
                for k in sorted(v):
                    walk(v[k], f"{at}['{k}']")
            elif isinstance(v, list):
                for i, w in enumerate(v):
                    walk(w, f"{at}[{i}]")

        walk(value, "$")
        return json.dumps(out, ensure_ascii=False, separators=(",", ":"))

    return dynamic(in_pandas(paths, "string", x.col))
