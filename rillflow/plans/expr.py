"""Expressions to typed Spark columns.

Predicates are two-valued: a null operand gives false.  Where a predicate stands
alone in a filter, the bare Spark predicate does the same and reaches the scan,
so ``predicate`` returns that form and ``scalar`` the total one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lang import tree as t
from ..lang.lexer import QueryError
from . import typed as ty
from .typed import Typed

FALSE = F.lit
EDGE = "0-9A-Za-z"


def quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", text) if text else ""


def has_term(s: Column, term: Typed, before: bool = True, after: bool = True, cased: bool = False) -> Column:
    """A term whose neighbours are no ASCII letters or digits."""
    left, right = (f"(?<![{EDGE}])" if before else ""), (f"(?![{EDGE}])" if after else "")
    if term.const:
        word = str(term.value if term.value is not None else "")
        if not word:
            return F.lit(False)
        return s.rlike(f"{'' if cased else '(?iu)'}{left}{quote(word)}{right}")
    word = ty.text(term)
    quoted = F.regexp_replace(word, r"([^0-9A-Za-z])", r"\\$1")
    return F.when(F.length(word) > 0, F.call_function("rlike", s, F.concat(F.lit(("" if cased else "(?iu)") + left), quoted, F.lit(right)))).otherwise(False)


def like(pattern: str) -> str:
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else quote(c) for c in pattern) + "$"


def like_column(pattern: Column) -> Column:
    """``like`` of a pattern that differs from row to row."""
    quoted = F.regexp_replace(pattern, r"([^0-9A-Za-z*?])", r"\\$1")
    return F.concat(F.lit("(?i)^"), F.replace(F.replace(quoted, F.lit("?"), F.lit(".")), F.lit("*"), F.lit(".*")), F.lit("$"))


class Binder:
    """Binds expressions over the columns of one frame.

    ``names``: column to Typed.  ``scope``: let bindings, user functions and the
    engine, which runs subqueries.
    """

    def __init__(self, names: dict[str, Typed], scope, extra: dict[str, dict[str, Typed]] | None = None):
        self.names, self.scope, self.extra = names, scope, extra or {}

    # -- entry points
    def __call__(self, e) -> Typed:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def predicate(self, e) -> Column:
        """For a filter: what is not true goes, so null need not become false."""
        if isinstance(e, t.Binary) and e.op in ("and", "or"):
            a, b = self.predicate(e.left), self.predicate(e.right)
            return a & b if e.op == "and" else a | b
        return self._raw_predicate(e)

    def _raw_predicate(self, e) -> Column:
        if isinstance(e, t.Binary) and e.op not in ("+", "-", "*", "/", "%", "and", "or"):
            return self._compare(e)
        if isinstance(e, t.Between):
            return self._range(e)
        x = self(e)
        return x.col if x.type == "bool" else F.lit(False)

    # -- nodes
    def _lit(self, e: t.Lit) -> Typed:
        if e.type.endswith(":raw"):
            return ty.raw_literal(e.value, e.type[:-4])
        if e.type == "null":
            return Typed(F.lit(None).cast("string"), "null", None, True)
        return ty.literal(e.value, e.type)

    def _name(self, e: t.Name) -> Typed:
        if e.name in self.names:
            return self.names[e.name]
        found = self.scope.scalar(e.name)
        if found is not None:
            return found
        raise QueryError(f"unknown column {e.name}")

    def _type(self, e: t.Type) -> Typed:
        return ty.literal(e.name, "string")

    def _star(self, e) -> Typed:
        raise QueryError("* cannot stand here")

    def _item(self, e: t.Item) -> Typed:
        return self(e.expr)

    def _not(self, e: t.Not) -> Typed:
        return Typed(~F.coalesce(self.predicate(e.arg), F.lit(False)), "bool")

    def _minus(self, e: t.Minus) -> Typed:
        x = self(e.arg)
        return Typed(-(x.col if x.type in (*ty.NUMERIC, "timespan") else ty.as_real(x)), x.type if x.type in (*ty.NUMERIC, "timespan") else "real")

    def _between(self, e: t.Between) -> Typed:
        return Typed(F.coalesce(self._range(e), F.lit(False)), "bool")

    def _range(self, e: t.Between) -> Column:
        x = self(e.arg)
        low, high = self(e.low), self(e.high)
        if x.type == "datetime" and high.type == "timespan":
            high = Typed(shift(low.col, high.col), "datetime")
        a, b, _ = align(x, low)
        c, d, _ = align(x, high)
        found = (a >= b) & (c <= d)
        return ~found if e.negated else found

    def _binary(self, e: t.Binary) -> Typed:
        if e.op in ("and", "or"):
            a, b = (F.coalesce(self.predicate(x), F.lit(False)) for x in (e.left, e.right))
            return Typed(a & b if e.op == "and" else a | b, "bool")
        if e.op in ("+", "-", "*", "/", "%"):
            return arithmetic(e.op, self(e.left), self(e.right))
        out = self._compare(e)
        return Typed(F.coalesce(out, F.lit(False)), "bool")

    def _compare(self, e: t.Binary) -> Column:
        op = e.op
        if isinstance(e.left, t.Star):  # any column
            out = F.lit(False)
            for name, x in self.names.items():
                if x.type in ("string", "guid", "dynamic") or op in ("has", "contains"):
                    out = out | F.coalesce(self._operate(op, x, self(e.right)), F.lit(False))
            return out
        return self._operate(op, self(e.left), self(e.right))

    def _operate(self, op: str, left: Typed, right: Typed) -> Column:
        if op in ("==", "!=", "<", "<=", ">", ">="):
            a, b, _ = align(left, right)
            if op == "==":
                # null == null is true; beside a literal plain equality is the same and can be pushed to a scan.
                return a == b if (right.const and right.value is not None) or (left.const and left.value is not None) else a.eqNullSafe(b)
            return {"!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
        s, word = ty.text(left), op.lstrip("!")
        negated, cased = op[0] == "!", word.endswith("_cs")
        word = word.removesuffix("_cs")
        if word in ("=~", "~"):
            out = F.lower(s) == F.lower(ty.text(right))
            return ~out if op == "!~" else out
        if word == "matches regex":
            return F.call_function("rlike", s, regex(right))
        if word == "like":
            out = s.rlike(like(str(right.value or ""))) if right.const else F.call_function("rlike", s, like_column(ty.text(right)))
        elif word == "has":
            out = has_term(s, right, cased=cased)
        elif word == "hasprefix":
            out = has_term(s, right, after=False, cased=cased)
        elif word == "hassuffix":
            out = has_term(s, right, before=False, cased=cased)
        else:
            a, b = (s, ty.text(right)) if cased else (F.lower(s), F.lower(ty.text(right)))
            out = {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[word](a, b)
        return ~out if negated else out

    def _in(self, e: t.In) -> Typed:
        left = self(e.left)
        word = e.op.lstrip("!").rstrip("~")
        if word in ("has_any", "has_all"):
            terms = [x for i in e.items for x in self._terms(i)]
            out = F.lit(word == "has_all")
            for x in terms:
                one = F.coalesce(has_term(ty.text(left), x), F.lit(False))
                out = out & one if word == "has_all" else out | one
            return Typed(out, "bool")
        low = e.op.endswith("~")
        s = F.lower(ty.text(left)) if low else ty.text(left)
        out = F.lit(False)
        values = []
        for item in e.items:
            for x in self._terms(item):
                if x.const and x.value is not None and not low and x.type == left.type and x.type in ("long", "string", "real"):
                    values.append(x.value)
                else:
                    out = out | F.coalesce(s == (F.lower(ty.text(x)) if low else ty.text(x)), F.lit(False))
        if values:
            out = out | F.coalesce(left.col.isin(values), F.lit(False))
        return Typed(left.col.isNotNull() & ~out if e.op[0] == "!" else out, "bool")

    def _terms(self, e) -> list[Typed]:
        """The values of one entry of an ``in`` list."""
        if isinstance(e, t.Sub) or isinstance(e, t.Name) and e.name not in self.names and self.scope.scalar(e.name) is None:
            return self.scope.first_column(e)
        x = self(e)
        if x.type == "dynamic" and x.const and isinstance(x.value, list):
            return [ty.literal(v if not isinstance(v, (list, dict)) else ty.canonical(v), {bool: "bool", int: "long", float: "real"}.get(type(v), "string")) for v in x.value]
        return [x]

    def _sub(self, e: t.Sub) -> Typed:
        return self.scope.first_cell(e.query)

    def _member(self, e: t.Member) -> Typed:
        if isinstance(e.base, t.Name) and e.base.name in self.extra and isinstance(e.key, str):
            found = self.extra[e.base.name]
            if e.key not in found:
                raise QueryError(f"unknown column {e.base.name}.{e.key}")
            return found[e.key]
        dotted = path_text(e)
        if dotted and dotted in self.names and dotted.split(".")[0] not in self.names:
            return self.names[dotted]
        base = self(e.base)
        v = F.try_parse_json(base.col)
        if isinstance(e.key, str) or isinstance(e.key, t.Lit) and e.key.type == "string":
            key = e.key if isinstance(e.key, str) else e.key.value
            field = "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']" if not re.fullmatch(r"[A-Za-z_]\w*", key) else f"$.{key}"
            one = F.to_json(F.try_variant_get(v, field, "variant"))
            each = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.try_variant_get(x, field, "variant"))
            return Typed(F.coalesce(one, F.to_json(each)), "dynamic")
        key = self(e.key)
        if key.type in ("string", "dynamic"):
            return Typed(F.to_json(F.try_variant_get(v, F.concat(F.lit("$."), ty.text(key)), "variant")), "dynamic")
        array = F.try_variant_get(v, "$", "array<variant>")
        last = isinstance(e.key, t.Minus) and isinstance(e.key.arg, t.Lit) and e.key.arg.type == "long" and e.key.arg.value > 0
        if last:
            num = None if base.nums is None else F.try_element_at(base.nums, F.lit(-e.key.arg.value))
            return Typed(F.to_json(F.try_element_at(array, F.lit(-e.key.arg.value))), "dynamic", num=num)
        if base.size is not None and key.const and key.type == "long" and 0 <= key.value < base.size:
            num = F.get(base.nums, F.lit(key.value))
            return Typed(F.when(base.nums.isNotNull(), F.coalesce(ty.real_text(num), F.lit("null"))), "dynamic", num=num)
        at = ty.as_long(key)
        num = F.get(base.nums, F.lit(key.value)) if base.nums is not None and key.const and key.type == "long" and 0 <= key.value < 1 << 31 else None
        at = F.when(at < 0, F.size(array) + at).otherwise(at)
        return Typed(F.to_json(F.get(array, at.cast("int"))), "dynamic", num=num)

    def _call(self, e: t.Call) -> Typed:
        from ..functions import registry

        user = self.scope.function(e.name) if hasattr(self.scope, "function") else None
        if user is None:
            user = next((f for n, f in self.scope.functions().items() if n.lower() == e.name), None)
        if user is not None:
            return self.scope.call_scalar(user, [self(a) for a in e.args], self)
        if e.name in registry.LAZY:
            return registry.LAZY[e.name](self, e)
        if e.name not in registry.FUNCTIONS:
            raise QueryError(f"unknown function {e.name}")
        return registry.FUNCTIONS[e.name](*[self(a) for a in e.args])


def path_text(e) -> str | None:
    if isinstance(e, t.Name):
        return e.name
    if isinstance(e, t.Member) and isinstance(e.key, str):
        base = path_text(e.base)
        return f"{base}.{e.key}" if base else None
    return None


def regex(x: Typed) -> Column:
    """A pattern in Java's spelling: named groups differ."""
    if x.const:
        return F.lit(str(x.value or "").replace("(?P<", "(?<"))
    return F.replace(ty.text(x), F.lit("(?P<"), F.lit("(?<"))


def shift(moment: Column, ticks: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + ty._div(ticks, 10))


def align(a: Typed, b: Typed) -> tuple[Column, Column, str]:
    """Both sides as one type, that of the typed side where the other is text or JSON."""
    if a.type == b.type and a.type != "dynamic":
        return a.col, b.col, a.type
    if a.type == b.type == "dynamic":
        return ty.text(a), ty.text(b), "string"
    if a.type in ty.NUMERIC and b.type in ty.NUMERIC:
        kind = "real" if "real" in (a.type, b.type) else "long"
        return ty.cast(a, kind).col, ty.cast(b, kind).col, kind
    if a.type == "null" or b.type == "null":
        kind = b.type if a.type == "null" else a.type
        return ty.cast(a, kind).col, ty.cast(b, kind).col, kind
    if "dynamic" in (a.type, b.type):
        kind = b.type if a.type == "dynamic" else a.type
        kind = "real" if kind in ("long", "int") else kind
        return ty.cast(a, kind).col, ty.cast(b, kind).col, kind
    return ty.cast(a, a.type).col, ty.cast(b, a.type).col, a.type


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    if "datetime" in (a.type, b.type):
        if a.type == b.type == "datetime" and op == "-":
            return Typed((ty.micros(a.col) - ty.micros(b.col)) * 10, "timespan")
        if op == "+" and "timespan" in (a.type, b.type):
            moment, span = (a, b) if a.type == "datetime" else (b, a)
            return Typed(shift(moment.col, span.col), "datetime")
        if op == "-" and b.type in ("timespan", "long"):
            return Typed(shift(a.col, -b.col), "datetime")
        raise QueryError(f"no {a.type} {op} {b.type}")
    a, b = (Typed(ty.as_real(x), "real") if x.type in ("string", "dynamic", "guid", "null") else Typed(x.col.cast("bigint"), "long") if x.type == "bool" else x for x in (a, b))
    spans = [x.type == "timespan" for x in (a, b)]
    whole = "real" not in (a.type, b.type)
    x, y = a.col, b.col
    if not whole:
        x, y = x.cast("double"), y.cast("double")
    kind = "timespan" if any(spans) and not (all(spans) and op == "/") else "long" if whole else "real"
    if op == "/":
        if all(spans):
            return Typed(F.try_divide(x.cast("double"), y.cast("double")), "real")
        out = ty._div(x, y) if whole else F.when(y != 0, x / F.when(y != 0, y))
    elif op == "%":
        out = F.try_mod(x, y)
    elif whole:
        out = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](x, y)
    else:
        out = {"+": x + y, "-": x - y, "*": x * y}[op]
    return Typed(out.cast("bigint") if kind == "timespan" else out, kind)
