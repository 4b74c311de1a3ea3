"""Vocabulary files by name; the folder is a parameter, and workers get the contents by broadcast."""

from __future__ import annotations

import base64
import json
import os
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from .hashing import buffers, spans
from .pretokens import PartCache, PartStore, library_piece, library_pieces, odd

IDS, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Bytes of texts whose parts are looked up together; a longer text is encoded alone, part by part.
TOGETHER = 1 << 23


def path(name: str, folder: str | None = None) -> str:
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def library_file(spark: SparkSession, folder: str | None = None) -> Broadcast:
    """The text of the tokenizers file, about 2 MB whatever the corpus."""
    with open(path(IDS, folder), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def read_ranks(folder: str | None = None) -> dict[bytes, int]:
    with open(path(RANKS, folder), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class IdCache:
    """``encode`` gives a text's ids as ``Tokenizer.encode(text, add_special_tokens=False)``, as little-endian 32-bit integers.

    The library cuts a text at its added tokens, ``<|endoftext|>`` among them,
    the longest at the leftmost place, before anything else; so does this.
    """

    def __init__(self, file: str, pattern: str):
        added = json.loads(file)["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take spaces or whole words are not supported")
        self.added = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        tokenizer = Tokenizer.from_str(file)
        self.parts = PartCache(pattern, library_piece(tokenizer), limit=200_000)
        self.store = PartStore(pattern, library_pieces(tokenizer), self.parts.line)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else None

    def encode(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            return self.parts.encode(text)
        return b"".join([self.added[x] if k % 2 else self.parts.encode(x) for k, x in enumerate(self.cut(text))])

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, null as empty, in order."""
        _, offsets = buffers(texts)
        for i, j in spans(offsets, TOGETHER):
            some = texts.slice(i, j - i).fill_null("")
            whole = some.to_numpy(zero_copy_only=False).tolist()
            plain = [len(x) <= TOGETHER and not odd(x) and not any(t in x for t in self.added) for x in whole]
            found = iter(self.store.encode(some if all(plain) else some.filter(pa.array(plain))))
            for text, known in zip(whole, plain):
                yield next(found) if known else np.frombuffer(self.encode(text), dtype="<u4")


def id_cache(file: str, pattern: str) -> IdCache:
    """This worker process's own: words that one task met are known to its next.  ``sys`` holds it, as code that travels by value has no module there."""
    held = sys.__dict__.setdefault("_rillflow_ids", {})
    if (file, pattern) not in held:
        held.clear()
        held[file, pattern] = IdCache(file, pattern)
    return held[file, pattern]
