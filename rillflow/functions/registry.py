"""Scalar functions by lower-case name.

``FUNCTIONS`` take typed columns and give one; ``LAZY`` get the binder and the
call, for those that bind their arguments themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang.lexer import QueryError
from ..plans import typed as ty
from ..plans.typed import Typed

FUNCTIONS: dict[str, Callable[..., Typed]] = {}
LAZY: dict[str, Callable] = {}


def function(*names: str):
    def keep(f):
        def checked(*args: Typed) -> Typed:
            try:
                return f(*args)
            except TypeError as e:
                if "positional argument" in str(e):
                    raise QueryError(f"{names[0]}: wrong number of arguments") from None
                raise

        for n in names:
            FUNCTIONS[n] = checked
        return f

    return keep


def lazy(*names: str):
    def keep(f):
        for n in names:
            LAZY[n] = f
        return f

    return keep


def string(col: Column) -> Typed:
    return Typed(col, "string")


def long(col: Column) -> Typed:
    return Typed(col.cast("bigint"), "long")


def real(col: Column) -> Typed:
    return Typed(col.cast("double"), "real")


def boolean(col: Column) -> Typed:
    return Typed(col, "bool")


def dynamic(col: Column) -> Typed:
    return Typed(col, "dynamic")


def in_pandas(f: Callable, kind: str, *cols: Column) -> Column:
    """A vectorised Python function of texts, where no built-in expression has the semantics."""

    def over(*series: pd.Series) -> pd.Series:
        return pd.Series([f(*(None if v is None or v is pd.NA else v for v in row)) for row in zip(*series)], dtype=object if kind in ("string", "boolean") else "Int64" if kind == "bigint" else None)

    # One series at least, and one parameter for each column: pandas_udf reads the function's signature.
    forms = {1: lambda a: over(a), 2: lambda a, b: over(a, b), 3: lambda a, b, c: over(a, b, c)}
    call = forms[len(cols)]
    call.__annotations__ = {n: pd.Series for n in ("a", "b", "c")[: len(cols)]} | {"return": pd.Series}
    return F.pandas_udf(call, kind)(*cols)


def array(x: Typed) -> Column:
    """The elements of a dynamic array; null for anything else."""
    return F.try_variant_get(F.try_parse_json(x.col), "$", "array<variant>")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def texts(x: Typed) -> Column:
    """The elements of a dynamic array as texts; a JSON null as null."""
    return F.transform(array(x), lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))


def reals(x: Typed) -> Column:
    """The elements as numbers; what is no JSON number as null."""
    return F.transform(array(x), lambda v: F.to_json(v).try_cast("double")) if x.nums is None else x.nums


def listed(items: Column) -> Typed:
    """A dynamic array of elements that are JSON as it is written."""
    return Typed(json_array(items), "dynamic", jsons=items)


def numbers(nums: Column, finite: bool = False) -> Typed:
    """A dynamic array of reals.  Text with a NaN or an infinity is no JSON."""
    nums = F.transform(nums, lambda v: v + F.lit(0.0))
    sound = nums if finite else let(nums, lambda s: F.when(F.forall(s, lambda v: v.isNull() | (F.abs(v) < F.lit(float("inf")))), s))
    return Typed(json_reals(nums), "dynamic", nums=sound)


def json_array(col: Column) -> Column:
    """JSON text of an array of JSON texts; null elements as null."""
    return F.concat(F.lit("["), F.array_join(col, ",", "null"), F.lit("]"))


def json_reals(col: Column) -> Column:
    return json_array(F.transform(col, lambda x: ty.real_text(x)))


def elementwise(f: Callable[..., Column], *xs: Typed, finite: bool = False) -> Typed:
    """A dynamic array of f of the numbers at each place; plain expressions where the size is known."""
    size = xs[0].size
    if size is None or size > 16 or any(x.size != size for x in xs):
        values = [reals(x) for x in xs]
        return numbers(F.transform(values[0], f) if len(xs) == 1 else F.zip_with(*values, f), finite)
    known = xs[0].nums.isNotNull()
    for x in xs[1:]:
        known = known & x.nums.isNotNull()
    values = [f(*[F.get(x.nums, F.lit(i)) for x in xs]) + F.lit(0.0) for i in range(size)]
    text = F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(ty.real_text(v), F.lit("null")) for v in values]), F.lit("]"))
    sound = known
    for v in [] if finite else values:
        sound = sound & F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(True))
    return Typed(F.when(known, text), "dynamic", nums=F.when(sound, F.array(*values)), size=size)


def json_text(col: Column) -> Column:
    """A text as a JSON string."""
    return ty.json_string(col)


def json_object(pairs: list[tuple[Column | str, Column]]) -> Column:
    """JSON text of an object from (key, JSON text); keys sorted, the last of equal keys wins."""
    if all(isinstance(k, str) for k, _ in pairs):
        named = lambda k: F.concat(json_text(F.lit(k)), F.lit(":")) if re.search(r'["\\\x00-\x1f]', k) else F.lit(f'"{k}":')
        fields = [F.concat(named(k), v) for k, v in sorted(dict(pairs).items())]
        return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    entries = F.array(*[F.struct((F.lit(k) if isinstance(k, str) else k).alias("k"), F.lit(i).alias("i"), v.alias("v")) for i, (k, v) in enumerate(pairs)])
    last = let(F.array_sort(entries), lambda s: F.filter(s, lambda x, i: (i == len(pairs) - 1) | (F.get(s, i + 1)["k"] != x["k"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(last, lambda x: F.concat(json_text(x["k"]), F.lit(":"), x["v"])), ","), F.lit("}"))


from . import convert, datetimes, dynamics, network, series, strings, vector  # noqa: E402, F401
