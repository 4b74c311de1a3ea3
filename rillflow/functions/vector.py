"""Vectors: similarity, and embedding by a provider that the engine's user sets."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import functions as F

from ..plans.typed import text
from .registry import dynamic, function, in_pandas, let, real, reals
from .series import total


def hashed(text: str, model: str | None = None, size: int = 64) -> list[float]:
    """A deterministic embedding of words by hashing; a stand-in where no model is at hand."""
    out = [0.0] * size
    for word in text.lower().split():
        h = hashlib.sha256(f"{model or ''}:{word}".encode()).digest()
        out[h[0] % size] += 1.0 if h[1] & 1 else -1.0
    return out


_provider: list[Callable] = [hashed]


def set_provider(f: Callable[[str, str | None], list[float]]) -> None:
    """``f(text, model)`` gives a list of numbers; it runs on the executors."""
    _provider[0] = f


@function("embed_text")
def embed_text(x, model=None):
    f = _provider[0]
    name = str(model.value) if model is not None and model.const else None
    return dynamic(in_pandas(lambda s: None if s is None else json.dumps([int(v) if float(v).is_integer() else float(v) for v in f(s, name)], separators=(",", ":")), "string", text(x)))


def _both(a, b, f):
    """f of the numbers of both, each parsed once."""
    return let(F.struct(reals(a).alias("x"), reals(b).alias("y")), lambda s: f(s["x"], s["y"]))


def _dot(x, y):
    same = F.when(F.size(x) != F.size(y), F.raise_error(F.lit("vectors of different lengths")).cast("double"))
    return F.coalesce(same, total(F.zip_with(x, y, lambda p, q: p * q), 0.0, lambda s, v: s + v))


@function("series_dot_product")
def dot_product(a, b):
    return real(_both(a, b, lambda x, y: F.when(x.isNotNull() & y.isNotNull(), _dot(x, y))))


@function("series_cosine_similarity")
def cosine(a, b):
    length = lambda v: F.sqrt(total(v, 0.0, lambda s, e: s + e * e))
    out = lambda x, y: let(length(x) * length(y), lambda norm: F.when(norm > 0, _dot(x, y) / F.when(norm > 0, norm)).when(norm == 0, 0.0))
    return real(_both(a, b, out))
