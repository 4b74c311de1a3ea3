"""Packing documents into training sequences beside their lexical neighbours.

``cut``: texts are encoded once; whole windows of long documents are pieces as
they stand, and the rest of each document (less than a window) is written.  With
the rests goes a count, by id, of the documents that hold it.

``Stats``: BM25's document frequencies and document count over all documents,
whole texts, and the mean length of all rests.  Two numbers for each id of the
vocabulary, whatever the corpus.

``routed``: the index is sharded by content, not by file.  Each rest draws
``DRAWS`` of its ids, in races that are the same for all documents and weighted
by idf squared (a weighted min-hash): rests draw equal ids the more often the more
weight they share.  Rests are range-partitioned and sorted by what they drew,
then by a unique row number, so a group of copies of any size is split.

``Packer``: each run of ``SHARD`` sorted rests is a shard with a BM25 inverted
index.  A seed's best unused neighbours fill its window, the last one is cut
where the window ends, and its tail is the next seed.  So every window is full.
The last window of a partition is split into lengths that are powers of two,
which need no padding.

A seed is answered by its own shard; other shards hold rests that drew other ids.
Ids that more than a quarter of a shard's documents hold are scored from a dense
block, a row for each; an id of one document alone scores no other.

Defined cases: null or empty text is its end id alone; repeated rows and ids and
null ids are documents like others.  Other columns are ignored, an empty table
gives no sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer_files
from .work import Scratch

LENGTH, SHARD, END, DRAWS = 2048, 512, 1, 8
K1, B = 1.2, 0.75
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Whole windows have a sequence and no row; rests a row and no sequence; counts of ids neither.
CUT = f"{PIECES}, row long, terms array<int>, holders array<long>, documents long"


class Stats(NamedTuple):
    """What BM25 takes from the corpus: the idf of each id, the mean length; and the places of ids in each race."""

    idf: np.ndarray
    mean: float
    places: np.ndarray

    @classmethod
    def of(cls, terms: np.ndarray, holders: np.ndarray, documents: int, mean: float) -> Stats:
        """From the number of documents that hold each of terms."""
        df = np.zeros(int(terms.max(initial=0)) + 1)
        df[terms] = holders
        idf = np.log1p((documents - df + 0.5) / (df + 0.5))
        weight = np.where(df > 1, idf * idf, 0) + 1e-12
        race = np.random.default_rng(0).standard_exponential((len(df), DRAWS)).T / weight
        return cls(idf, mean, np.argsort(np.argsort(race, axis=1, kind="stable"), axis=1, kind="stable").astype(np.min_scalar_type(len(df))))

    def route(self, ids: np.ndarray) -> bytes:
        """The winner of each race among ids, as its place among all ids; orders as bytes."""
        return self.places.take(ids, axis=1).min(axis=1).astype(">u4").tobytes()


class Index:
    """BM25 scores of a shard's documents for one of them; without ``stats`` the shard is the corpus."""

    def __init__(self, docs: list[np.ndarray], common: float = 0.25, stats: Stats | None = None):
        ids = np.concatenate(docs).astype(np.int64)
        most = int(ids.max(initial=0)) + 1
        key, tf = np.unique(np.repeat(np.arange(len(docs)) * most, [len(d) for d in docs]) + ids, return_counts=True)
        doc, term, tf = key // most, key % most, tf.astype(np.float64)
        df = np.bincount(term)
        self.terms = np.flatnonzero(df)
        place, df = (np.cumsum(df > 0) - 1)[term], df[self.terms]
        idf = stats.idf[self.terms] if stats else np.log1p((len(docs) - df + 0.5) / (df + 0.5))
        size = np.array([len(d) for d in docs], dtype=np.float64)
        weight = idf[place] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc] / (stats.mean if stats else size.mean())))
        often = df > max(2, common * len(docs))
        use = ~often[place] & (df > 1)[place]
        order = np.flatnonzero(use)[np.argsort(place[use].astype(np.min_scalar_type(len(self.terms))), kind="stable")]
        self.row = np.where(often, np.cumsum(often) - 1, -1)
        self.dense = np.zeros((often.sum(), len(docs)))
        self.dense[self.row[place[often[place]]], doc[often[place]]] = weight[often[place]]
        self.doc, self.weight = doc[order], weight[order]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(place[order], minlength=len(self.terms)))])
        self.own = np.split(place, np.cumsum(np.bincount(doc, minlength=len(docs)))[:-1])
        self.n = len(docs)

    def scores(self, seed: int) -> np.ndarray:
        own = self.own[seed]
        rows = self.row[own]
        out = self.dense[rows[rows >= 0]].sum(axis=0)
        n = self.begin[own + 1] - self.begin[own]
        own, n = own[n > 0], n[n > 0]
        if not len(own):
            return out
        at = np.arange(n.sum()) + np.repeat(self.begin[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return out + np.bincount(self.doc[at], self.weight[at], minlength=self.n)


class Packer:
    """Pieces of one partition.  ``shard`` takes rests as (doc_id, start, ids, tokens of the document); ``close`` ends the open window."""

    def __init__(self, first: int, length: int, stats: Stats | None = None):
        self.sequence, self.length, self.stats = first, length, stats
        self.open: list[tuple[int, int, int]] = []  # rest, start in it, length
        self.filled = 0
        self.out: list[tuple] = []
        self.docs: list[tuple] = []

    def _add(self, doc: int, start: int, length: int) -> None:
        self.open.append((doc, start, length))
        self.filled += length
        if self.filled == self.length:
            self._end()

    def _end(self) -> None:
        offset = 0
        for doc, start, length in self.open:
            name, first, ids, tokens = self.docs[doc]
            self.out.append((name, first + start, length, ids[start : start + length].tobytes(), tokens, self.sequence, offset))
            offset += length
        self.sequence, self.open, self.filled = self.sequence + 1, [], 0

    def _fill(self, doc: int, start: int) -> int:
        """Puts what fits of a rest from start on; where its tail starts."""
        n = min(len(self.docs[doc][2]) - start, self.length - self.filled)
        self._add(doc, start, n)
        return start + n

    def shard(self, docs: list[tuple]) -> None:
        base = len(self.docs)
        self.docs += docs
        sizes = [len(ids) for _, _, ids, _ in docs]
        index = Index([ids for _, _, ids, _ in docs], stats=self.stats)
        unused = np.ones(len(docs), dtype=bool)
        at, first = [0] * len(docs), 0
        tail: int | None = None
        while True:
            if tail is None:
                while first < len(docs) and not unused[first]:
                    first += 1
                if first == len(docs):
                    break
                tail = first
                unused[tail] = False
            seed, tail = tail, None
            at[seed] = self._fill(base + seed, at[seed])
            if at[seed] < sizes[seed]:
                tail = seed
                continue
            if not self.filled:
                continue
            for r in np.argsort(-index.scores(seed), kind="stable"):
                if unused[r]:
                    unused[r] = False
                    at[r] = self._fill(base + r, at[r])
                    if at[r] < sizes[r]:
                        tail = int(r)
                    if not self.filled:
                        break

    def take(self) -> list[tuple]:
        """The finished pieces; documents stay while the open window holds them."""
        out, self.out = self.out, []
        keep = sorted({d for d, _, _ in self.open})
        place = {d: i for i, d in enumerate(keep)}
        self.docs, self.open = [self.docs[d] for d in keep], [(place[d], s, n) for d, s, n in self.open]
        return out

    def close(self) -> None:
        waiting, self.open, total, self.filled = self.open, [], self.filled, 0
        full = self.length
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                self.length = 1 << bit
                while self.filled or not self.open and waiting:
                    doc, start, n = waiting.pop(0)
                    part = min(n, self.length - self.filled)
                    if part < n:
                        waiting.insert(0, (doc, start + part, n - part))
                    before = self.sequence
                    self._add(doc, start, part)
                    if self.sequence > before:
                        break
        self.length = full


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _schema(*more: tuple) -> pa.Schema:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.schema([*zip([x.split()[0] for x in PIECES.split(", ")], kinds), *more])


def _place() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 40


def cut(batches: Iterator[pa.RecordBatch], file: str, pattern: str, length: int) -> Iterator[pa.RecordBatch]:
    """Whole windows, rests, and at the end the counts of ids of one partition."""
    cache = tokenizer_files.id_cache(file, pattern)
    end = np.array([END], dtype="<u4")
    schema = _schema(("row", pa.int64()), ("terms", pa.list_(pa.int32())), ("holders", pa.list_(pa.int64())), ("documents", pa.int64()))
    row, documents = _place(), 0
    sequence = row | 1 << 39  # not those of Packer
    holders, last = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for batch in batches:
        out = []
        for name, known in zip(batch.column(0).to_pylist(), cache.encode_all(batch.column(1))):
            ids = np.concatenate((known, end))
            data = ids.tobytes()
            if (more := int(ids.max()) + 1 - len(last)) > 0:
                holders, last = np.pad(holders, (0, more)), np.pad(last, (0, more))
            at = np.arange(len(ids))
            last[ids] = at
            holders[ids[last[ids] == at]] += 1  # each id once
            whole = len(ids) // length * length
            for start in range(0, whole, length):
                out.append((name, start, length, data[4 * start : 4 * (start + length)], len(ids), sequence, 0, None, None, None, None))
                sequence += 1
            if whole < len(ids):
                out.append((name, whole, len(ids) - whole, data[4 * whole :], len(ids), None, None, row, None, None, None))
                row += 1
            documents += 1
        yield _batch(out, schema)
    if documents:
        held = np.flatnonzero(holders)
        yield _batch([(None,) * 8 + (held, holders[held], documents)], schema)


def routed(batches: Iterator[pa.RecordBatch], stats: Stats) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        routes = [stats.route(np.frombuffer(x, dtype="<u4")) for x in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(routes, pa.binary())], names=[*batch.schema.names, "route"])


def packed(batches: Iterator[pa.RecordBatch], stats: Stats, length: int, shard: int) -> Iterator[pa.RecordBatch]:
    packer, schema = Packer(_place(), length, stats), _schema()
    waiting: list[tuple] = []
    for batch in batches:
        for name, start, data, tokens in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "start", "ids", "doc_tokens"))):
            waiting.append((name, start, np.frombuffer(data, dtype="<u4"), tokens))
            if len(waiting) == shard:
                packer.shard(waiting)
                waiting = []
                yield _batch(packer.take(), schema)
    if waiting:
        packer.shard(waiting)
    packer.close()
    yield _batch(packer.take(), schema)


def corpus_stats(pieces: DataFrame) -> Stats:
    """From what ``cut`` wrote: a row for each id of the vocabulary, and one more, come to the driver."""
    counts = pieces.filter("documents IS NOT NULL")
    held = counts.select(F.explode(F.arrays_zip("terms", "holders")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.holders").alias("n")).collect()
    documents = counts.agg(F.sum("documents")).first()[0] or 0
    mean = pieces.filter("row IS NOT NULL").agg(F.avg("length")).first()[0] or 1.0
    return Stats.of(np.array([r.term for r in held], dtype=np.int64), np.array([r.n for r in held], dtype=np.int64), documents, mean)


def pack(docs: DataFrame, length: int = LENGTH, shard: int = SHARD, folder: str | None = None) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit): doc_id, start, length, ids, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    file, pattern = tokenizer_files.library_file(spark, folder), tokenizer_files.pattern()
    names = [x.split()[0] for x in PIECES.split(", ")]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = Scratch(spark, "packing").put(texts.mapInArrow(lambda b: cut(b, file.value, pattern, length), CUT), "cut")
    stats = spark.sparkContext.broadcast(tuple(corpus_stats(pieces)))  # plain arrays: workers may lack the package
    rests = pieces.filter("row IS NOT NULL").select("doc_id", "start", "ids", "doc_tokens", "row")
    rests = rests.mapInArrow(lambda b: routed(b, Stats(*stats.value)), "doc_id long, start long, ids binary, doc_tokens long, row long, route binary")
    rests = rests.repartitionByRange("route", "row").sortWithinPartitions("route", "row")
    return pieces.filter("sequence_id IS NOT NULL").select(*names).unionAll(rests.mapInArrow(lambda b: packed(b, Stats(*stats.value), length, shard), PIECES))
