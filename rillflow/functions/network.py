"""Addresses, hashes, encodings, URLs, paths and command lines."""

from __future__ import annotations

import ipaddress
import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import typed as ty
from ..plans.typed import Typed, text
from .registry import boolean, dynamic, function, in_pandas, json_object, json_text, let, long, string, texts

QUAD = r"^\s*(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?:/(\d{1,2}))?\s*$"


def address(col: Column) -> Column:
    """A dotted quad, with or without a prefix, as a number; null if it is none."""
    part = [F.regexp_extract(col, QUAD, k).try_cast("bigint") for k in range(1, 5)]
    good = col.rlike(QUAD) & (F.greatest(*part) <= 255)
    return F.when(good, ((part[0] * 256 + part[1]) * 256 + part[2]) * 256 + part[3])


def prefix(col: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(col, QUAD, 5), F.lit("")).try_cast("bigint"), F.lit(32))


def masked(ip: Column, bits: Column) -> Column:
    """The first bits of an address."""
    size = F.pow(F.lit(2.0), F.lit(32) - bits).cast("bigint")
    return ip - F.pmod(ip, size)


def dotted(ip: Column) -> Column:
    byte = lambda k: F.pmod(F.floor(ip / 256**k), F.lit(256)).cast("string")
    return F.concat_ws(".", byte(3), byte(2), byte(1), byte(0))


@function("parse_ipv4")
def parse_ipv4(x):
    return long(F.when(~text(x).contains("/"), address(text(x))))


@function("ipv4_is_private")
def ipv4_is_private(x):
    a = address(text(x))
    within = lambda base, bits: masked(a, F.lit(bits)) == F.lit(int(ipaddress.IPv4Address(base)))
    return boolean(within("10.0.0.0", 8) | within("172.16.0.0", 12) | within("192.168.0.0", 16))


def in_range(ip: Column, net: Column) -> Column:
    bits = prefix(net)
    return F.when(bits <= 32, masked(address(ip), bits) == masked(address(net), bits))


@function("ipv4_is_in_range")
def ipv4_is_in_range(x, net):
    return boolean(in_range(text(x), text(net)))


def _any(xs: tuple[Typed, ...], test, none: Column) -> Column:
    if len(xs) == 1 and xs[0].type == "dynamic":
        return F.coalesce(F.exists(texts(xs[0]), lambda v: F.coalesce(test(v), F.lit(False))), none)
    out = F.lit(False)
    for x in xs:
        out = out | F.coalesce(test(text(x)), F.lit(False))
    return out


@function("ipv4_is_in_any_range")
def ipv4_is_in_any_range(x, *nets):
    found = _any(nets, lambda n: in_range(text(x), n), F.lit(False))
    return boolean(F.when(address(text(x)).isNotNull(), found))


def _pair(a: Typed, b: Typed, bits: Typed | None) -> tuple[Column, Column]:
    n = F.least(prefix(text(a)), prefix(text(b)), ty.as_long(bits) if bits is not None else F.lit(32).cast("bigint"))
    return masked(address(text(a)), n), masked(address(text(b)), n)


@function("ipv4_is_match")
def ipv4_is_match(a, b, bits=None):
    x, y = _pair(a, b, bits)
    return boolean(x == y)


@function("ipv4_compare")
def ipv4_compare(a, b, bits=None):
    x, y = _pair(a, b, bits)
    return long(F.when(x < y, -1).when(x > y, 1).when(x == y, 0))


@function("ipv4_netmask_suffix")
def ipv4_netmask_suffix(x):
    return long(F.when(address(text(x)).isNotNull() & (prefix(text(x)) <= 32), prefix(text(x))))


def _least(x: Typed, bits: Typed | None) -> Column:
    own = prefix(text(x))
    return F.least(own, ty.as_long(bits)) if bits is not None else own


@function("format_ipv4")
def format_ipv4(x, bits=None):
    n = _least(x, bits)
    a = x.col.cast("bigint") if x.type == "long" else address(text(x))
    return string(F.coalesce(F.when((n >= 0) & (n <= 32), dotted(masked(a, n if x.type != "long" else (ty.as_long(bits) if bits is not None else F.lit(32))))), F.lit("")))


@function("format_ipv4_mask")
def format_ipv4_mask(x, bits=None):
    n = _least(x, bits) if x.type != "long" else (ty.as_long(bits) if bits is not None else F.lit(32).cast("bigint"))
    a = x.col.cast("bigint") if x.type == "long" else address(text(x))
    out = F.concat(dotted(masked(a, n)), F.lit("/"), n.cast("string"))
    return string(F.coalesce(F.when(a.isNotNull() & (n >= 0) & (n <= 32), out), F.lit("")))


@function("parse_ipv4_mask")
def parse_ipv4_mask(x, bits):
    n = ty.as_long(bits)
    return long(F.when((n >= 0) & (n <= 32), masked(address(text(x)), n)))


def _delimited(s: Column, word: Column) -> Column:
    quoted = F.regexp_replace(word, r"([^0-9A-Za-z])", r"\\$1")
    return F.call_function("rlike", s, F.concat(F.lit("(?<![0-9A-Za-z])"), quoted, F.lit("(?![0-9A-Za-z])")))


def _has_ipv4(s: Column, ip: Column) -> Column:
    plain = F.when(address(ip).isNotNull(), _delimited(s, ip)).otherwise(False)
    in_net = F.exists(F.split(s, r"\s+"), lambda w: F.coalesce(in_range(F.regexp_extract(w, r"(\d+\.\d+\.\d+\.\d+)", 1), ip), F.lit(False)))
    return F.when(ip.contains("/"), in_net).otherwise(plain)


@function("has_ipv4")
def has_ipv4(x, ip):
    return boolean(F.coalesce(_has_ipv4(text(x), text(ip)), F.lit(False)))


@function("has_any_ipv4")
def has_any_ipv4(x, *ips):
    return boolean(_any(ips, lambda ip: _has_ipv4(text(x), ip), F.lit(False)))


def _has_prefix(s: Column, start: Column) -> Column:
    """The prefix starts an address: what stands before it is no part of the same one."""
    good = start.rlike(r"^(\d{1,3}\.){1,3}$|^(\d{1,3}\.){3}\d{1,3}$")
    inside = F.concat(F.lit("(?<![0-9]\\.)"), F.lit("(?<![0-9A-Za-z])"), F.replace(start, F.lit("."), F.lit("\\.")), F.when(start.endswith("."), "").otherwise("(?![0-9A-Za-z])"))
    return F.when(good, F.call_function("rlike", s, inside)).otherwise(False)


@function("has_ipv4_prefix")
def has_ipv4_prefix(x, start):
    return boolean(F.coalesce(_has_prefix(text(x), text(start)), F.lit(False)))


@function("has_any_ipv4_prefix")
def has_any_ipv4_prefix(x, *starts):
    return boolean(_any(starts, lambda p: _has_prefix(text(x), p), F.lit(False)))


@function("ipv4_range_to_cidr_list")
def ipv4_range_to_cidr_list(a, b):
    def nets(x, y):
        try:
            return json.dumps([str(n) for n in ipaddress.summarize_address_range(ipaddress.IPv4Address(x), ipaddress.IPv4Address(y))], separators=(",", ":"))
        except (ValueError, TypeError):
            return None

    return dynamic(in_pandas(nets, "string", text(a), text(b)))


def _v6(value: str | None, bits: int | None = None):
    """A network of the address with the smaller of its own and the given prefix; IPv4 is mapped."""
    if value is None:
        return None
    host, _, own = value.strip().partition("/")
    try:
        ip = ipaddress.ip_address(host)
        n = int(own) if own else None
    except ValueError:
        return None
    if isinstance(ip, ipaddress.IPv4Address):
        ip = ipaddress.IPv6Address(f"::ffff:{ip}")
        n = None if n is None else n + 96
    n = min(x for x in (n, bits, 128) if x is not None)
    return (int(ip) >> (128 - n) << (128 - n), n) if 0 <= n <= 128 else None


def _expand(value: str | None, bits=None) -> str:
    found = _v6(value, None if bits is None else int(bits))
    return ":".join(f"{found[0]:032x}"[i : i + 4] for i in range(0, 32, 4)) if found else ""


@function("parse_ipv6")
def parse_ipv6(x):
    return string(in_pandas(_expand, "string", text(x)))


@function("parse_ipv6_mask")
def parse_ipv6_mask(x, bits):
    return string(in_pandas(_expand, "string", text(x), ty.as_long(bits)))


def _compare6(a, b, bits=None):
    x, y = _v6(a), _v6(b)
    if not x or not y:
        return None
    n = min(v for v in (x[1], y[1], None if bits is None else int(bits)) if v is not None)
    p, q = x[0] >> (128 - n), y[0] >> (128 - n)
    return (p > q) - (p < q)


@function("ipv6_compare")
def ipv6_compare(a, b, bits=None):
    return long(in_pandas(_compare6, "bigint", text(a), text(b), *([ty.as_long(bits)] if bits is not None else [])))


@function("ipv6_is_match")
def ipv6_is_match(a, b, bits=None):
    return boolean(ipv6_compare(a, b, bits).col == 0)


def _inside6(ip, net):
    x, n = _v6(ip), _v6(net)
    return None if not x or not n else x[0] >> (128 - n[1]) == n[0] >> (128 - n[1])


@function("ipv6_is_in_range")
def ipv6_is_in_range(x, net):
    return boolean(in_pandas(_inside6, "boolean", text(x), text(net)))


@function("ipv6_is_in_any_range")
def ipv6_is_in_any_range(x, *nets):
    one = nets[0].col if len(nets) == 1 and nets[0].type == "dynamic" else F.to_json(F.array(*[text(n) for n in nets]))

    def any_(ip, all_):
        if not _v6(ip):
            return None
        return any(_inside6(ip, n) for n in json.loads(all_ or "[]"))

    return boolean(in_pandas(any_, "boolean", text(x), one))


@function("hash_sha256")
def hash_sha256(x):
    return string(F.sha2(F.encode(text(x), "UTF-8"), 256))


@function("hash_md5")
def hash_md5(x):
    return string(F.md5(F.encode(text(x), "UTF-8")))


@function("hash_sha1")
def hash_sha1(x):
    return string(F.sha1(F.encode(text(x), "UTF-8")))


@function("base64_encode_tostring")
def base64_encode(x):
    return string(F.base64(F.encode(text(x), "UTF-8")))


@function("base64_decode_tostring")
def base64_decode(x):
    return string(F.try_to_binary(text(x), F.lit("base64")).cast("string"))


@function("new_guid")
def new_guid():
    return Typed(F.uuid(), "guid")


@function("rand")
def rand(n=None):
    return long(F.floor(F.rand() * ty.as_real(n))) if n is not None else Typed(F.rand(), "real")


@function("parse_url")
def parse_url(x):
    s = text(x)
    p = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)(?::(\d*))?)?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    names = {"Scheme": 1, "Host": 2, "Port": 3, "Path": 4, "Query": 5, "Fragment": 6}
    return dynamic(F.when(s.isNotNull(), json_object([(k, json_text(F.regexp_extract(s, p, g))) for k, g in names.items()])))


@function("parse_urlquery")
def parse_urlquery(x):
    s = F.regexp_replace(text(x), r"^\?", "")
    key = lambda p: F.substring_index(p, "=", 1)
    last = lambda parts: F.filter(parts, lambda p, i: ~F.exists(F.slice(parts, i + 2, F.size(parts)), lambda q: key(q) == key(p)))
    kept = let(F.filter(F.split(s, "&"), lambda p: p != ""), last)
    pairs = F.array_sort(F.transform(kept, lambda p: F.struct(key(p).alias("k"), F.when(p.contains("="), F.substring(p, F.length(key(p)) + 2, F.length(p))).otherwise("").alias("v"))))
    return dynamic(F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(json_text(p["k"]), F.lit(":"), json_text(p["v"]))), ","), F.lit("}")))


@function("parse_path")
def parse_path(x):
    s = text(x)
    p = r"^(?:(.*)[/\\])?([^/\\]*)$"
    folder, name = F.regexp_extract(s, p, 1), F.regexp_extract(s, p, 2)
    extension = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    return dynamic(F.when(s.isNotNull(), json_object([("DirectoryName", json_text(folder)), ("FileName", json_text(name)), ("Extension", json_text(extension)), ("FileNameNoExtension", json_text(bare))])))


def split_command(line: str | None, kind: str = "windows") -> str | None:
    """Arguments by the Windows rules: 2n backslashes before a quote are n, an odd one escapes it."""
    if line is None or kind.lower() != "windows":
        return None
    out, word, quoted, started, i = [], "", False, False, 0
    while i < len(line):
        c = line[i]
        if c == "\\":
            n = len(line[i:]) - len(line[i:].lstrip("\\"))
            i += n
            started = True
            if line[i : i + 1] == '"':
                word += "\\" * (n // 2)
                if n % 2:
                    word += '"'
                    i += 1
            else:
                word += "\\" * n
            continue
        if c == '"':
            quoted, started = not quoted, True
        elif c in " \t" and not quoted:
            if started:
                out.append(word)
            word, started = "", False
        else:
            word, started = word + c, True
        i += 1
    return json.dumps(out + [word] if started else out, ensure_ascii=False, separators=(",", ":"))


@function("parse_command_line")
def parse_command_line(x, kind):
    return dynamic(in_pandas(split_command, "string", text(x), text(kind)))


#: Families in the order in which they are tried; a small set of our own.
BROWSERS = [("Edge", r"Edg(?:e|A|iOS)?/(\d+)(?:\.(\d+))?(?:\.(\d+))?"), ("Opera", r"OPR/(\d+)(?:\.(\d+))?(?:\.(\d+))?"), ("Firefox", r"Firefox/(\d+)(?:\.(\d+))?(?:\.(\d+))?"), ("Chrome", r"(?:Chrome|CriOS)/(\d+)(?:\.(\d+))?(?:\.(\d+))?"), ("Safari", r"Version/(\d+)(?:\.(\d+))?(?:\.(\d+))?.*Safari"), ("IE", r"(?:MSIE |rv:)(\d+)(?:\.(\d+))?"), ("curl", r"curl/(\d+)(?:\.(\d+))?(?:\.(\d+))?")]
SYSTEMS = [("Windows", r"Windows NT (\d+)(?:\.(\d+))?"), ("iOS", r"(?:iPhone|iPad).*? OS (\d+)(?:_(\d+))?(?:_(\d+))?"), ("Android", r"Android (\d+)(?:\.(\d+))?(?:\.(\d+))?"), ("Mac OS X", r"Mac OS X (\d+)(?:[._](\d+))?(?:[._](\d+))?"), ("Linux", r"Linux")]
DEVICES = [("iPhone", r"iPhone"), ("iPad", r"iPad"), ("Mac", r"Macintosh"), ("Generic Smartphone", r"Android.*Mobile"), ("Generic Tablet", r"Android")]


def user_agent(line: str | None, wanted: str) -> str | None:
    if line is None:
        return None
    kinds = json.loads(wanted) if wanted.startswith("[") else [wanted]
    out: dict = {}
    for label, key, rules in (("Browser", "browser", BROWSERS), ("OperatingSystem", "os", SYSTEMS), ("Device", "device", DEVICES)):
        if key in kinds:
            name, found = next(((n, m) for n, p in rules if (m := re.search(p, line))), ("Other", None))
            versions = [g or "" for g in found.groups()] if found else []
            out[label] = {"Family": name} | ({} if key == "device" else dict(zip(("MajorVersion", "MinorVersion", "Patch"), (versions + ["", "", ""])[:3])))
    return ty.canonical(out)


@function("parse_user_agent")
def parse_user_agent(x, kind):
    return dynamic(in_pandas(user_agent, "string", text(x), kind.col if kind.type == "dynamic" else text(kind)))
