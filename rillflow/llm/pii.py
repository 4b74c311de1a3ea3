"""Personal data by fixed patterns, and more of it by bootstrapped contexts.

A first pass finds the base entities and, beside them, every other stretch that
looks like an identifier, each with its lexical patterns: the word before it,
the two words before it, the word after it, and the words on both sides.  Those
without a pattern stay out of the graph but are marked if their value is accepted.
Base entities are the seeds.  Over the graph of patterns and values Spark then
scores in ``ROUNDS`` rounds: a pattern's confidence for a kind is the share of its
distinct values that are of that kind, each by its score, shrunk for small counts;
a value's score is that of its best pattern.  What reaches ``ACCEPT`` is a span of
its own, wherever the value stands.

What can be such a stretch is fixed: 7 to 25 characters of digits, parentheses,
points, hyphens and spaces, or a mail-like one (local part of at most 64
characters, at most 6 further parts, "(at)" and "(dot)" too).  A word of a
pattern stands at most three characters that are no letters away from its neighbour.

Values and patterns are aggregated before any join, all joins are sort-merge joins,
and the graph never leaves the cluster.  The pass over the texts runs once and
writes no text.

Defined cases: null or empty text has no spans; rows and ids may repeat or be
null; added spans overlap no base span; of overlapping stretches the first counts;
a value accepted for two kinds is of that with the higher score, then of the
first in ``KINDS``.  Other columns are ignored, an empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Scratch

KINDS = ("email", "ip", "card", "phone")
ACCEPT, SUPPORT, SHRINK, ROUNDS = 0.8, 5, 1.0, 3

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
#: A match holds whole runs of digits, so none starts inside a run.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be an identifier without being a base one.
NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9().\x20-]{5,22}[0-9](?![0-9A-Za-z])")
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})(?:\x20?[(\[]at[)\]]\x20?|@)([A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]{1,63}){0,5})")
BEFORE = re.compile(r"(?:(?<![^\W\d_])([^\W\d_]+)[\W_]{1,3})?(?<![^\W\d_])([^\W\d_]+)[\W_]{0,3}\Z")
AFTER = re.compile(r"[\W_]{0,3}([^\W\d_]{1,40})")
#: Characters before a stretch in which the two words before it are looked for.
REACH = 80

SPAN = "struct<start:int,rank:int,end:int>"
FOUND = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base array<{SPAN}>, near array<struct<patterns:array<string>,value:string,kind:int,may:int,start:int,end:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: a local part runs back from each @ to the last match's end at most."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            last = m.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last if m else 0))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all base matches, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in (p.lstrip("0")[:4] or "0" for p in m.group().split(".")))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out)


def possible(value: str) -> int:
    """Which kinds a stretch can be, a bit for each."""
    digits = sum(c.isdigit() for c in value)
    if any(c.isalpha() for c in value):
        return 1
    return (2 if value.count(".") == 3 and digits >= 4 else 0) | (4 if 12 <= digits <= 19 else 0) | (8 if 7 <= digits <= 15 else 0)


def patterns(text: str, a: int, b: int) -> list[str]:
    """The lexical patterns that a stretch from a to b stands in."""
    left, right = BEFORE.search(text, max(0, a - REACH), a), AFTER.match(text, b)
    out = []
    if left:
        out.append(left.group(2).lower() + " *")
        if left.group(1):
            out.append(left.group(1).lower() + " " + out[0])
    if right:
        out.append("* " + right.group(1).lower())
        if left:
            out.append(left.group(2).lower() + " * " + right.group(1).lower())
    return out


def near_spans(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Base spans in a pattern, and every other identifier-like stretch that overlaps none before it."""
    other = [(m.start(), m.end()) for m in NUMBER.finditer(text)] if DIGIT.search(text) else []
    if "@" in text or "at)" in text or "at]" in text:
        other += [(m.start(), m.end()) for m in MAIL.finditer(text)]
    spans, at, reached, last = [(a, b, k, 1 << k) for a, k, b in base], 0, 0, 0
    for a, b in sorted(other):
        while at < len(base) and base[at][0] < b:  # base spans that start before b, and how far they reach
            reached = max(reached, base[at][2])
            at += 1
        may = possible(text[a:b])
        if may and reached <= a and last <= a:
            spans.append((a, b, None, may))
            last = b
    out = []
    for a, b, kind, may in spans:
        found_in = patterns(text, a, b)
        if found_in or kind is None:
            value = text[a:b].lower() if may == 1 else re.sub(r"[^0-9.]" if may & 2 else r"[^0-9]", "", text[a:b])
            out.append({"patterns": found_in, "value": value, "kind": kind, "may": may, "start": a, "end": b})
    return out


def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([(c, pa.int32()) for c in ("start", "rank", "end")])
    near = pa.struct([("patterns", pa.list_(pa.string())), ("value", pa.string()), *((c, pa.int32()) for c in ("kind", "may", "start", "end"))])
    for batch in batches:
        bases, nears, counts = [], [], [[], [], [], []]
        for text in batch.column(1):
            text = text.as_py() or ""
            own = base_spans(text)
            bases.append([{"start": a, "rank": k, "end": b} for a, k, b in own])
            nears.append(near_spans(text, own))
            for k in range(4):
                counts[k].append(sum(x[1] == k for x in own))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(bases, pa.list_(span)), pa.array(nears, pa.list_(near))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "near"])


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def bootstrapped(scratch: Scratch, near: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind) that the patterns accept; near: pattern, value, kind, may."""
    graph = scratch.put(near.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.bit_or("may").alias("may")), "graph")
    totals = graph.groupBy("pattern").agg(F.count("*").alias("total"))
    seeds = graph.filter("kind is not null").groupBy("value", "kind").agg(F.lit(1.0).alias("score"))
    seeds = scratch.put(seeds, "seeds")
    open_ = graph.filter("kind is null").select("pattern", "value", "may").join(seeds.select("value").hint("merge"), "value", "left_anti")
    scores = seeds
    for k in range(rounds):
        support = graph.select("pattern", "value").join(scores.hint("merge"), "value").groupBy("pattern", "kind").agg(F.sum("score").alias("mass"), F.count("*").alias("n"))
        confident = support.filter(F.col("n") >= SUPPORT).join(totals.hint("merge"), "pattern").select("pattern", F.col("kind").alias("k"), (F.col("mass") / (F.col("total") + SHRINK)).alias("confidence"))
        confident = scratch.put(confident.filter(F.col("confidence") >= ACCEPT / 2), f"patterns-{k}")
        fits = F.col("may").bitwiseAND(F.expr("shiftleft(1, k)")) != 0
        new = open_.join(confident.hint("merge"), "pattern").filter(fits).groupBy("value", F.col("k").alias("kind")).agg(F.max("confidence").alias("score"))
        scores = scratch.put(seeds.unionByName(new), f"scores-{k}")
    return scores.filter(F.col("score") >= ACCEPT).groupBy("value").agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))


def extract(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base and spans (arrays of start, rank of the kind, end) for every row."""
    scratch = Scratch(docs.sparkSession, "pii")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(found, FOUND)
    rows = scratch.put(rows.withColumn("row", F.monotonically_increasing_id()), "found")
    near = rows.select("row", F.explode("near").alias("x")).select("row", "x.*")
    accepted = scratch.put(bootstrapped(scratch, near.select(F.explode("patterns").alias("pattern"), "value", "kind", "may")), "accepted")
    added = near.filter("kind is null").select("row", "value", "start", "end").join(accepted.hint("merge"), "value")
    added = added.groupBy("row").agg(F.collect_list(F.struct("start", F.col("kind").alias("rank"), "end")).alias("added"))
    out = rows.drop("near").join(added.hint("merge"), "row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", spans.alias("spans"))


def _redacted(text: pd.Series, start: pd.Series, rank: pd.Series, end: pd.Series) -> pd.Series:
    names, out = [f"<{k}>" for k in KINDS], []
    for t, starts, ranks, ends in zip(text, start, rank, end):
        if t is None or starts is None or not len(starts):
            out.append(t)
            continue
        parts, at = [], 0
        for a, k, b in zip(starts, ranks, ends):
            if a >= at:
                parts += (t[at:a], names[k])
            at = max(at, b)
        out.append("".join(parts) + t[at:])
    return pd.Series(out, dtype=object)


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by <kind>; what overlaps an earlier span goes with it."""
    return F.pandas_udf(_redacted, "string")(text, spans["start"], spans["rank"], spans["end"])
