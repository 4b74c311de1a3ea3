"""Results as text: table, csv, tsv, json or jsonl, row by row from the executors."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

from pyspark.sql import functions as F

from .plans import typed as ty
from .plans.frame import Frame


def values(frame: Frame) -> Iterator[list]:
    """Rows of plain values: moments and spans as text, JSON parsed by nobody."""
    cols = [(ty.text(x) if x.type in ("datetime", "timespan") else x.col).alias(f"c{i}") for i, x in enumerate(frame.names.values())]
    df = frame.df.orderBy(*frame.sort_columns()) if frame.order else frame.df
    for row in (df.select(*cols) if cols else df.select(F.lit(None))).toLocalIterator():
        yield list(row)


def _text(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else ty_real(v) if isinstance(v, float) else str(v)


def ty_real(v: float) -> str:
    return str(int(v)) if v.is_integer() and abs(v) < 1e15 else repr(v)


def lines(frame: Frame, mode: str = "table") -> Iterator[str]:
    names = list(frame.types)
    if mode == "table":
        rows = [[_text(v) for v in r] for r in values(frame)]
        width = [max([len(n), *(len(r[i]) for r in rows)]) for i, n in enumerate(names)]
        yield "  ".join(n.ljust(w) for n, w in zip(names, width)).rstrip()
        yield "  ".join("-" * w for w in width)
        for r in rows:
            yield "  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip()
    elif mode in ("csv", "tsv"):
        for r in [names, *([_text(v) for v in r] for r in values(frame))]:
            out = io.StringIO()
            csv.writer(out, delimiter="," if mode == "csv" else "\t", lineterminator="").writerow(r)
            yield out.getvalue()
    elif mode in ("json", "jsonl"):
        items = (json.dumps(dict(zip(names, r)), ensure_ascii=False) for r in values(frame))
        if mode == "jsonl":
            yield from items
        else:
            yield "[" + ",\n".join(items) + "]"
    else:
        raise ValueError(f"unknown mode {mode}")
