"""Text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import typed as ty
from ..plans.expr import has_term, regex
from ..plans.typed import Typed, text
from .registry import boolean, dynamic, function, json_array, json_text, long, string, texts


@function("strlen", "string_size")
def strlen(x):
    return long(F.coalesce(F.octet_length(text(x)), F.lit(0)))


@function("tolower")
def tolower(x):
    return string(F.lower(text(x)))


@function("toupper")
def toupper(x):
    return string(F.upper(text(x)))


@function("strcat")
def strcat(*xs):
    return string(F.concat(*[F.coalesce(text(x), F.lit("")) for x in xs]))


@function("substring")
def substring(x, start, length=None):
    s, at = text(x), F.greatest(ty.as_long(start), F.lit(0))
    n = F.greatest(ty.as_long(length), F.lit(0)) if length else F.length(s)
    return string(F.substring(s, (at + 1).cast("int"), n.cast("int")))


@function("split")
def split(x, delimiter):
    pattern = F.concat(F.lit("\\Q"), text(delimiter), F.lit("\\E"))
    return dynamic(json_array(F.transform(F.split(text(x), pattern, -1), json_text)))


def _group(n: Typed, pattern: Typed):
    """The number of a group given by number or name."""
    import re

    if n.type == "string" and n.const and pattern.const:
        return F.lit(re.compile(str(pattern.value)).groupindex.get(n.value, -1))
    return ty.as_long(n).cast("int")


@function("extract")
def extract(pattern, group, x, kind=None):
    import re

    s, p = text(x), regex(pattern)
    if pattern.const and group.const and isinstance(group.value, int):
        try:
            if group.value > re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", str(pattern.value))).groups:
                return string(F.lit(None).cast("string"))
        except re.error:
            return string(F.lit(None).cast("string"))
    out = string(F.when(F.call_function("rlike", s, p), F.call_function("regexp_extract", s, p, _group(group, pattern))))
    return ty.cast(out, kind.value) if kind and kind.value != "string" else out


@function("extract_all")
def extract_all(pattern, *rest):
    import re

    groups, x = (rest[0], rest[1]) if len(rest) == 2 else (None, rest[0])
    compiled = re.compile(str(pattern.value))
    if groups is not None and isinstance(groups.value, list):
        wanted = [compiled.groupindex.get(g, 0) if isinstance(g, str) else int(g) for g in groups.value]
    else:
        wanted = list(range(1, compiled.groups + 1))
    if not wanted:
        return dynamic(F.lit(None).cast("string"))
    s, p = text(x), regex(pattern)
    each = [F.transform(F.regexp_extract_all(s, p, F.lit(g)), json_text) for g in wanted]
    if len(each) == 1:
        out = json_array(each[0])
    else:
        zipped = F.arrays_zip(*[e.alias(f"g{i}") for i, e in enumerate(each)])
        out = json_array(F.transform(zipped, lambda z: json_array(F.array(*[z[f"g{i}"] for i in range(len(each))]))))
    return dynamic(F.when(F.call_function("rlike", s, p), out))


@function("replace_string")
def replace_string(x, old, new):
    return string(F.when(F.length(text(old)) > 0, F.replace(text(x), text(old), text(new))).otherwise(text(x)))


@function("replace_regex")
def replace_regex(x, pattern, new):
    if new.const:
        import re

        to = re.sub(r"\\(\d)", r"$\1", str(new.value).replace("$", r"\$"))
        return string(F.regexp_replace(text(x), regex(pattern), F.lit(to)))
    return string(F.regexp_replace(text(x), regex(pattern), F.regexp_replace(F.replace(text(new), F.lit("$"), F.lit("\\$")), r"\\(\d)", r"\$$1")))


def _ends(x, pattern, start: bool, end: bool):
    out, p = text(x), regex(pattern)
    if start:
        out = F.regexp_replace(out, F.concat(F.lit("^(?:"), p, F.lit(")+")), F.lit(""))
    if end:
        out = F.regexp_replace(out, F.concat(F.lit("(?:"), p, F.lit(")+$")), F.lit(""))
    return string(out)


@function("trim")
def trim(pattern, x):
    return _ends(x, pattern, True, True)


@function("trim_start")
def trim_start(pattern, x):
    return _ends(x, pattern, True, False)


@function("trim_end")
def trim_end(pattern, x):
    return _ends(x, pattern, False, True)


@function("indexof")
def indexof(x, lookup, start=None):
    at = F.greatest(ty.as_long(start), F.lit(0)) if start else F.lit(0)
    found = F.call_function("locate", text(lookup), text(x), (at + 1).cast("int")) - 1
    return long(F.when(at >= F.greatest(F.length(text(x)), F.lit(1)), F.lit(-1)).otherwise(found) if start else found)


@function("has_any_index")
def has_any_index(x, terms):
    if terms.const and isinstance(terms.value, list):
        out = F.lit(-1)
        for i, term in reversed(list(enumerate(terms.value))):
            out = F.when(has_term(text(x), ty.literal(str(term), "string")), F.lit(i)).otherwise(out)
        return long(F.when(x.col.isNull(), -1).otherwise(out))
    each = F.transform(texts(terms), lambda w: has_term(text(x), Typed(w, "string")))
    return long(F.coalesce(F.array_position(each, True) - 1, F.lit(-1)))


@function("countof")
def countof(x, search):
    s, w = text(x), text(search)
    return long(F.coalesce(F.when(F.length(w) > 0, (F.length(s) - F.length(F.replace(s, w, F.lit("")))) / F.length(w)), F.lit(0)))


@function("reverse")
def reverse(x):
    return string(F.reverse(text(x)))


@function("isempty")
def isempty(x):
    return boolean(F.coalesce(text(x), F.lit("")) == "")


@function("isnotempty", "notempty")
def isnotempty(x):
    return boolean(F.coalesce(text(x), F.lit("")) != "")


@function("strcmp")
def strcmp(a, b):
    x, y = (F.coalesce(text(v), F.lit("<nil>")) for v in (a, b))
    return long(F.when(x < y, -1).when(x > y, 1).otherwise(0))


@function("strrep")
def strrep(x, n, delimiter=None):
    times = F.greatest(ty.as_long(n), F.lit(0)).cast("int")
    parts = F.array_repeat(text(x), times)
    return string(F.array_join(parts, "") if delimiter is None else F.concat_ws("", F.when(times > 0, F.concat(F.repeat(F.concat(text(x), text(delimiter)), times - 1), text(x))).otherwise("")))


@function("translate")
def translate(search, replace, x):
    return string(F.call_function("translate", text(x), text(search), text(replace)))


@function("strcat_delim")
def strcat_delim(delimiter, *xs):
    return string(F.call_function("concat_ws", text(delimiter), *[F.nullif(text(x), F.lit("")) for x in xs]))


@function("url_decode")
def url_decode(x):
    out = text(x)
    for a, b in (("%20", " "), ("%26", "&"), ("%3D", "="), ("%2B", "+"), ("%25", "%")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return string(out)


@function("url_encode_component")
def url_encode_component(x, space="%20"):
    out = text(x)
    for a, b in (("%", "%25"), (" ", space), ("&", "%26"), ("=", "%3D"), ("+", "%2B")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return string(out)


@function("url_encode")
def url_encode(x):
    out = text(x)
    for a, b in (("%", "%25"), ("+", "%2B"), (" ", "+"), ("&", "%26"), ("=", "%3D")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return string(out)

