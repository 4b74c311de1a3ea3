"""Byte-level BPE: encoding by ranked merges over the bytes of distinct words, decoding by joining pieces.

``encode`` cuts texts into words by the public pattern and folds ranked merges
over each distinct word once per worker: the rank map is a literal of fixed
size that travels by broadcast.  ``decode`` joins the byte pieces of ids.

``native_word_ids`` is the same fold as a Spark higher-order expression over a
frame of distinct words, with the rank map as a literal in hashed groups.  It
gives the same ids; the README has its speed, which keeps it off the main path.

Defined cases: null or empty text has no ids and decodes to no bytes; a word of
any length is encoded (long ones by a heap); rows keep their ids, repeated or
null.  Other columns are ignored, an empty table gives none.
"""

from __future__ import annotations

import heapq
import json
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokenizer_files
from .hashing import buffers, spans
from .pretokens import PartCache

SHORT, GROUPS, NO_RANK = 48, 8192, 1 << 30


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    if len(parts) > SHORT:
        return _merged_long(parts, ranks)
    get = ranks.get
    pairs = [get(a + b, NO_RANK) for a, b in zip(parts, parts[1:])]
    while pairs:
        low = min(pairs)
        if low == NO_RANK:
            break
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], NO_RANK)
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], NO_RANK)
    return [ranks[p] for p in parts]


def _merged_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    n = len(parts)
    after, before, piece = list(range(1, n + 1)), list(range(-1, n - 1)), list(parts)
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        rank, i, size = heapq.heappop(heap)
        j = after[i] if piece[i] else n
        if j >= n or len(piece[i]) + len(piece[j]) != size or ranks.get(piece[i] + piece[j]) != rank:
            continue
        piece[i], piece[j] = piece[i] + piece[j], b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            b = after[a] if a >= 0 else n
            if b < n and (r := ranks.get(piece[a] + piece[b])) is not None:
                heapq.heappush(heap, (r, a, len(piece[a]) + len(piece[b])))
    return [ranks[p] for p in piece if p]


def word_encoder(ranks: dict[bytes, int]) -> Callable[[str], bytes]:
    return lambda word: array("I", merged(word.encode(), ranks)).tobytes()


def encoded(batches: Iterator[pa.RecordBatch], ranks: dict[bytes, int], pattern: str) -> Iterator[pa.RecordBatch]:
    cache = PartCache(pattern, word_encoder(ranks))
    for batch in batches:
        _, offsets = buffers(batch.column(1))
        for i, j in spans(offsets):
            ids = [cache.encode(t.as_py() or "") for t in batch.column(1).slice(i, j - i)]
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))], names=["doc_id", "ids"])


def decoded(batches: Iterator[pa.RecordBatch], pieces: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Adds the bytes that the ids stand for."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index("ids"))
        out = [b"".join([pieces[k] for k in x.values.to_numpy(zero_copy_only=False).tolist()]) if x.is_valid else None for x in lists]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])


def encode(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    ranks, pattern = docs.sparkSession.sparkContext.broadcast(tokenizer_files.read_ranks(folder)), tokenizer_files.pattern()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: encoded(b, ranks.value, pattern), "doc_id long, ids array<int>")


def decode(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """rows (doc_id, ids) with a binary column ``decoded``."""
    ranks = tokenizer_files.read_ranks(folder)
    pieces = rows.sparkSession.sparkContext.broadcast([p for p, _ in sorted(ranks.items(), key=lambda x: x[1])])
    return rows.select("doc_id", "ids").mapInArrow(lambda b: decoded(b, pieces.value), "doc_id long, ids array<int>, decoded binary")


def _rank_of(ranks: Column, pair: Column) -> Column:
    group = F.get(ranks, F.pmod(F.crc32(F.encode(pair, "UTF-8")), F.lit(GROUPS)).cast("int"))
    return F.coalesce(F.try_element_at(group, pair), F.lit(NO_RANK))


def native_word_ids(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """words (word) with ids, by a fold in higher-order functions alone."""
    groups: list[dict[str, int]] = [{} for _ in range(GROUPS)]
    for piece, rank in ranks.items():
        name = piece.hex().upper()
        groups[zlib.crc32(name.encode()) % GROUPS][name] = rank
    literal = F.from_json(F.lit(json.dumps(groups)), "array<map<string,int>>")
    nothing = F.struct(F.lit(NO_RANK).alias("rank"), F.lit(0).cast("int").alias("at"))

    def fold(parts: Column, _: Column) -> Column:
        pairs = F.when(F.size(parts) < 2, F.array(nothing)).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.struct(_rank_of(literal, F.concat(F.get(parts, i - 1), F.get(parts, i))).alias("rank"), i.alias("at"))))
        joined = lambda low: F.when(low["rank"] == NO_RANK, parts).otherwise(F.concat(F.slice(parts, F.lit(1), low["at"] - 1), F.array(F.concat(F.get(parts, low["at"] - 1), F.get(parts, low["at"]))), F.slice(parts, low["at"] + 2, F.size(parts))))
        return F.get(F.transform(F.array(F.array_min(pairs)), joined), F.lit(0))

    name = F.hex(F.encode("word", "UTF-8"))
    parts = F.regexp_extract_all(name, F.lit(".."), F.lit(0))
    whole = _rank_of(literal, name)
    folded = F.transform(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), parts, fold), lambda p: _rank_of(literal, p))
    return words.withColumn("ids", F.when(F.col("word") == "", F.array().cast("array<int>")).when(whole < NO_RANK, F.array(whole)).otherwise(folded))
