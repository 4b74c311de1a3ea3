"""A quality classifier: a factorisation machine on hashed words and the text's structure.

Features of a row: its text's words, hashed to ``WORDS`` places and weighted by
the logarithm of their counts; and ``STATS`` statistics, each marked in one of
``STEPS`` steps: those of the text's structure, and one of metadata, the stated
length ``n_chars`` in steps of its logarithm.  Pairwise interactions come from
low-rank factors in linear time, as half the difference of the square of sums
and the sum of squares.

The model is fitted on the driver on at most ``SAMPLE`` labelled rows, those
with the smallest hash of their id; every row is scored, whole, on the
executors.  The model has a fixed size of about 2.4 MB.

Defined cases: null or empty text has the statistics of an empty text and a
score like any other; an ``n_chars`` that is missing, null, negative or no number
has a step of its own; rows and ids may repeat or be null; without labelled rows
every score is 0.5.  Other columns are ignored, an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import U, Words, buffers, spans

BITS, RANK, STEPS, SAMPLE, THRESHOLD = 16, 8, 16, 8_000, 0.3
WORDS = 1 << BITS
CLASSES = ("upper", "punctuation", "digit", "other", "mark", "line")
STATS = len(CLASSES) + 8 + 1
SIZE = WORDS + STATS * STEPS

_kind = np.zeros((256, len(CLASSES)), dtype=bool)
_kind[65:91, 0] = True
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _kind[_a:_b, 1] = True
_kind[48:58, 2] = True
_kind[128:, 3] = True
_kind[np.frombuffer(b"!#$%&*|", np.uint8), 4] = True
_kind[10, 5] = True


def features(words: Words, kind: np.ndarray, data: np.ndarray, offsets: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values, and where each text's begin."""
    starts, ends, first = words.borders(data, offsets)
    hashes = words.hashes(data, starts, ends)
    n, size = np.diff(first).astype(np.float64), np.diff(offsets).astype(np.float64)
    doc = np.repeat(np.arange(len(n)), np.diff(first))
    text_of = np.repeat(np.arange(len(n)), np.diff(offsets))
    per = lambda mask, of, all_: np.bincount(of[mask], minlength=len(n)) / np.maximum(all_, 1)
    stats = [per(kind[data, c], text_of, size) for c in range(len(CLASSES))]
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(h)))
    who = d[at]
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    most = np.zeros(len(n))
    np.maximum.at(most, who, count)
    length = (ends - starts).astype(np.float64)
    marked = kind[data[np.maximum(ends - 1, 0)], 4]
    pair = np.zeros(len(hashes), dtype=bool)
    if len(pair) > 2:
        pair[2:] = marked[2:] & marked[1:-1] & (doc[2:] == doc[:-2])
    long_ = np.bincount(doc, length, minlength=len(n)) / np.maximum(n, 1)
    stats += [np.bincount(who, minlength=len(n)) / np.maximum(n, 1), per(same, doc, n), most / np.maximum(n, 1), np.minimum(long_ / 24, 1), np.log1p(n) / 12, per(marked, doc, n), per(pair, doc, n), per(length == 1, doc, n)]
    step = np.minimum((np.sqrt(np.clip(np.stack(stats, axis=1), 0, 1)) * STEPS).astype(np.int64), STEPS - 1)
    stated = np.where(chars >= 0, chars, 0)  # NaN, for null, is not
    step = np.column_stack([step, np.where(chars >= 0, 1 + np.minimum(np.log2(1 + stated) / 24 * (STEPS - 1), STEPS - 2), 0).astype(np.int64)])
    value = np.log1p(count)
    norm = np.sqrt(np.bincount(who, value * value, minlength=len(n)))
    value = value / np.maximum(norm, 1e-9)[who]
    cut = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(n)) + STATS)])
    index, values = np.empty(cut[-1], dtype=np.int64), np.empty(cut[-1], dtype=np.float32)
    place = np.arange(len(who)) + who * STATS
    index[place], values[place] = (h[at] >> U(64 - BITS)).astype(np.int64), value
    tail = cut[1:, None] - STATS + np.arange(STATS)
    index[tail], values[tail] = WORDS + np.arange(STATS) * STEPS + step, 1.0
    return index, values, cut


class Machine:
    """A factorisation machine with a logistic loss, fitted by AdaGrad in a fixed order."""

    def __init__(self, size: int = SIZE, rank: int = RANK, seed: int = 7):
        self.bias, self.w = 0.0, np.zeros(size, dtype=np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (size, rank)).astype(np.float32)

    def raw(self, index: np.ndarray, values: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[index] * values[:, None]
        sums = np.add.reduceat(vx, cut[:-1])
        square = np.add.reduceat((vx * vx).sum(axis=1), cut[:-1])
        return self.bias + np.add.reduceat(self.w[index] * values, cut[:-1]) + 0.5 * ((sums * sums).sum(axis=1) - square), sums

    def score(self, index: np.ndarray, values: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(index, values, cut)[0], -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 1000, least: int = 3, batch: int = 32, rate: float = 0.1, decay: float = 1e-5) -> None:
        """At least ``steps`` batches, and every row at least ``least`` times."""
        rng = np.random.default_rng(11)
        gw, gv, gb = np.full(self.w.shape, 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        for _ in range(max(least, -(-steps // -(-len(rows) // batch)))):
            order = rng.permutation(len(rows))
            for i in range(0, len(rows), batch):
                some = order[i : i + batch]
                index, values = np.concatenate([rows[k][0] for k in some]), np.concatenate([rows[k][1] for k in some])
                cut = np.concatenate([[0], np.cumsum([len(rows[k][0]) for k in some])])
                raw, sums = self.raw(index, values, cut)
                wrong = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]).astype(np.float32)
                who = np.repeat(np.arange(len(some)), np.diff(cut))
                used, place = np.unique(index, return_inverse=True)
                dw = np.bincount(place, wrong[who] * values, minlength=len(used)).astype(np.float32) / len(some) + decay * self.w[used]
                each = (wrong[who] * values)[:, None] * (sums[who] - self.v[index] * values[:, None])
                dv = np.zeros((len(used), self.v.shape[1]), dtype=np.float32)
                np.add.at(dv, place, each)
                dv = dv / len(some) + decay * self.v[used]
                db = float(wrong.mean())
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += db * db
                self.w[used] -= rate * dw / np.sqrt(gw[used])
                self.v[used] -= rate * dv / np.sqrt(gv[used])
                self.bias -= rate * db / gb**0.5


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, int, tuple]]:
    words = Words(71, lower=True)
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        chars = batch.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
        for i, j in spans(offsets):
            yield batch, i, j, features(words, _kind, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], chars[i:j])


def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, i, j, (index, values, cut) in _each(batches):
        at = pa.array(cut.astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(3).slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(index.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(values))], names=["doc_id", "label", "index", "value"])


def scored(batches: Iterator[pa.RecordBatch], machine: Machine) -> Iterator[pa.RecordBatch]:
    for batch, i, j, found in _each(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(machine.score(*found).astype(np.float64))], names=["doc_id", "score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def _inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text, chars: all that scores are made from, and the id they go with."""
    chars = F.expr("try_cast(n_chars as double)") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", chars.alias("chars"))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fitted on the labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("doc_id is not null and label is not null")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    # At most ``sample`` rows of two numbers, whatever the corpus.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = _inputs(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "chars", "label")
    # Rows that repeat an id go with the sample's; the limit holds for them as well.
    table = rows.mapInArrow(sampled, "doc_id long, label int, index array<int>, value array<float>").limit(2 * sample).toArrow()
    machine = Machine()
    if table.num_rows:
        table = table.sort_by("doc_id").combine_chunks()
        take = lambda name: np.split(table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False), np.cumsum(table.column(name).combine_chunks().value_lengths().to_numpy(zero_copy_only=False))[:-1])
        machine.fit(list(zip(take("index"), take("value"))), table.column("label").to_numpy().astype(np.float32))
    else:
        machine.v[:] = 0
    return machine


def score(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    rows = _inputs(docs).mapInArrow(lambda b: scored(b, sent.value), "doc_id long, score double")
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
