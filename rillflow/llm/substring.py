"""Removing passages that occur more than once, by a log-structured index of fingerprints.

Two equal windows of 35 words hold equal runs of 12 words with the smallest
hash among their 24 runs.  So the index keeps one fingerprint for each distinct
smallest run of a document, about a twelfth of its windows, and misses nothing.

``FingerprintIndex`` lives in a folder and grows by batches of documents.  A
batch's fingerprints are merge-joined with the sorted immutable runs of all
batches before it; a run has a row for each fingerprint: how many places (1, or
2 for more) and its first document.  A fingerprint of two places or more is a
hit for the batch's documents, and for the first document if it was alone until
then.  Then the batch becomes a run of its own, and more than ``FAN`` runs are
compacted into one.  Only hits are opened: consecutive windows with one
fingerprint are a stretch; equal stretches are one class, one of each is opened
into windows, and windows are equal if their words are.  Words are compared by
128-bit BLAKE2b digests of the words themselves, so no collision of the
fingerprints' hashes removes a word.

Defined cases: null or empty text has no words, removes nothing and keeps the
hash of the empty string; windows that overlap in one document count as two
places; rows that repeat a doc_id, or have none, are documents of their own.
Other columns are ignored, an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import Words, buffers, digest, spans, windows
from .work import Scratch, read_text, write_text

SIZE, GRAM, FAN, BATCHES = 35, 12, 3, 4
TEXTS = "row long, doc_id long, text string"
ENTRIES = "row long, keys array<long>, twice array<boolean>"
RUN = "print long, places long, first long"
FOUND = "row long, n_words long, kept_sha256 string, at array<int>, size array<int>, s1 array<long>, s2 array<long>"
WINDOWS = "row long, at int, w1 long, w2 long, weight int"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def smallest(grams: np.ndarray, span: int) -> np.ndarray:
    """The minimum of each ``span`` consecutive values."""
    out, have = grams, 1
    while 2 * have <= span:
        out, have = np.minimum(out[:-have], out[have:]), 2 * have
    rest = span - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def prints(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    """For each document (row, text) its distinct fingerprints, and which of them have two places in it."""
    words = Words(41, lower=False)
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        for i, j in spans(offsets):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, ends, first = words.borders(part, off)
            grams = windows(words.hashes(part, starts, ends), gram, 51)
            long = [d for d in range(j - i) if first[d + 1] - first[d] >= size]
            least = smallest(grams, size - gram + 1) if long else grams
            keys, twice = [], []
            for d in long:
                a, b = first[d], first[d + 1]
                own = np.unique(least[a : b - size + 1])
                all_ = np.sort(grams[a : b - gram + 1])
                keys.append(own.view(np.int64))
                twice.append(np.searchsorted(all_, own, "right") - np.searchsorted(all_, own, "left") > 1)
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32))
            join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.array(long, dtype=np.int64) + i)), pa.ListArray.from_arrays(at, join(keys, np.int64)), pa.ListArray.from_arrays(at, join(twice, bool))], names=["row", "keys", "twice"])


def joined(text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words with one space between them, and where each starts and ends in it."""
    words = text.split()
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    return b" ".join(words), np.concatenate([[0], ends + 1])[:-1], ends


def digests(line: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digests of ranges of bytes."""
    both = np.frombuffer(b"".join([digest(line[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), dtype="<i8")
    return both[0::2], both[1::2]


def candidates(batches: Iterator[pa.RecordBatch], size: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The stretches of windows with one fingerprint of the row's ``hot``, and digests of their words; a row without any is finished here."""
    words = Words(41, lower=False)
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        hots = batch.column(2)
        hot_values, hot_at = hots.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(np.array(hots.value_lengths().fill_null(0)))])
        n_words, shas, at, length, s1, s2 = [], [], [], [], [], []
        for d in range(batch.num_rows):
            part = data[offsets[d] : offsets[d + 1]]
            hot = hot_values[hot_at[d] : hot_at[d + 1]]
            if len(hot):
                starts, ends, _ = words.borders(part, np.array([0, len(part)]))
                least = smallest(windows(words.hashes(part, starts, ends), gram, 51), size - gram + 1)
                hot = np.sort(hot)
                near = hot[np.minimum(np.searchsorted(hot, least), len(hot) - 1)]
                where = np.flatnonzero(near == least)
                begin = np.flatnonzero(np.concatenate([[True], (np.diff(where) > 1) | (least[where[1:]] != least[where[:-1]])])[: len(where)])
                n_words.append(len(starts))
                shas.append(None)
                first, many = where[begin], np.diff(np.append(begin, len(where)))
                at.append(first.astype(np.int32))
                length.append(many.astype(np.int32))
                line, starts, ends = joined(part.tobytes())
                for out, half in zip((s1, s2), digests(line, starts[first], ends[first + many + size - 2])):
                    out.append(half)
            else:
                own = part.tobytes().split()
                n_words.append(len(own))
                shas.append(hashlib.sha256(b" ".join(own)).hexdigest())
                for out, kind in ((at, np.int32), (length, np.int32), (s1, np.int64), (s2, np.int64)):
                    out.append(np.zeros(0, kind))
        cuts = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in at])]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(x) if x else np.zeros(0, kind))) for x, kind in ((at, np.int32), (length, np.int32), (s1, np.int64), (s2, np.int64))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), *lists], names=["row", "n_words", "kept_sha256", "at", "size", "s1", "s2"])


def opened(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """A row for each window of the stretches (at, size, weight) of a document, with a digest of its words."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        rows, stretches = batch.column(0).to_numpy(), batch.column(2)
        at, length, weight = (stretches.flatten().field(k).to_numpy().astype(np.int64) for k in range(3))
        cuts = np.concatenate([[0], np.cumsum(np.array(stretches.value_lengths()))])
        for d in range(batch.num_rows):
            own = slice(cuts[d], cuts[d + 1])
            n = length[own]
            where = np.repeat(at[own] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            line, starts, ends = joined(data[offsets[d] : offsets[d + 1]].tobytes())
            both = digests(line, starts[where], ends[where + size - 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(where), rows[d])), pa.array(where.astype(np.int32)), *(pa.array(x) for x in both), pa.array(np.repeat(weight[own], n).astype(np.int32))], names=["row", "at", "w1", "w2", "weight"])


def without(text: bytes, at: np.ndarray, length: np.ndarray, size: int) -> list[bytes]:
    """The words of a text that no window covers; ``length`` windows start at each of ``at`` and the words after it."""
    words = text.split()
    step = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + length + size - 1, len(words)), -1)
    left = np.cumsum(step[:-1]) == 0
    return [words[i] for i in np.flatnonzero(left)]


def removed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, shas = [], []
        cover = batch.column(2)
        at, length = (cover.flatten().field(k).to_numpy().astype(np.int64) for k in range(2))
        cuts = np.concatenate([[0], np.cumsum(np.array(cover.value_lengths().fill_null(0)))])
        for d, (text, total) in enumerate(zip(batch.column(1), batch.column(3))):
            own = slice(cuts[d], cuts[d + 1])
            left = without(text.as_py().encode(), at[own], length[own], size)
            n.append(total.as_py() - len(left))
            shas.append(hashlib.sha256(b" ".join(left)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(n, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


class FingerprintIndex:
    """The index in a folder: texts by row number, sorted runs of fingerprints, and the hits found so far.

    ``add`` takes a batch, ``passages`` tells what all batches so far lose.  The
    state is one small file, written when a batch's tables stand: a batch that
    failed leaves nothing that is read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, size: int = SIZE, gram: int = GRAM, fan: int = FAN):
        self.spark, self.fan = spark, fan
        self.scratch = Scratch(spark, "substring", batch_rows=1000, path=path)
        found = read_text(spark, f"{self.scratch.path}/index.json")
        self.state = json.loads(found) if found else {"size": size, "gram": gram, "batches": [], "runs": [], "made": 0, "rows": 0}
        self.size, self.gram = self.state["size"], self.state["gram"]

    def _read(self, names: list[str], schema: str) -> DataFrame:
        paths = [f"{self.scratch.path}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def add(self, docs: DataFrame) -> None:
        """docs: doc_id, text."""
        state, scratch = dict(self.state), self.scratch
        k = state["made"] = state["made"] + 1
        number = (F.monotonically_increasing_id() + state["rows"]).alias("row")
        texts = scratch.put(docs.select(number, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), f"texts-{k}")
        state["rows"] = (texts.agg(F.max("row")).first()[0] or state["rows"]) + 1
        size, gram = self.size, self.gram
        printed = scratch.put(texts.select("row", "text").mapInArrow(lambda b: prints(b, size, gram), ENTRIES), f"prints-{k}")
        entries = printed.select("row", F.explode(F.arrays_zip("keys", "twice")).alias("x")).select("row", F.col("x.keys").alias("print"), F.when(F.col("x.twice"), 2).otherwise(1).cast("long").alias("places"))
        own = entries.groupBy("print").agg(F.least(F.sum("places"), F.lit(2).cast("long")).alias("places"), F.min("row").alias("first"))
        own = scratch.put(own.sortWithinPartitions("print"), f"run-{k}")
        if state["runs"]:
            before = self._merged(state["runs"]).select("print", F.col("places").alias("old"), F.col("first").alias("old_first"))
            met = scratch.put(own.join(before.hint("merge"), "print", "left").filter("old is not null or places > 1").drop("first"), f"met-{k}")
            alone = met.filter("old = 1").select(F.col("old_first").alias("row"), "print")
        else:
            met, alone = own.filter("places > 1"), None
        hits = entries.select("row", "print").join(met.select("print").hint("merge"), "print").select("row", "print")
        scratch.put(hits if alone is None else hits.unionByName(alone), f"hits-{k}")
        scratch.drop(f"prints-{k}", f"met-{k}")
        state["batches"], state["runs"] = [*state["batches"], k], [*state["runs"], f"run-{k}"]
        old: list[str] = []
        if len(state["runs"]) > self.fan:  # compaction: one sorted run in place of all
            old, state["made"] = state["runs"], k + 1
            state["runs"] = [f"run-{k + 1}"]
            scratch.put(self._merged(old).sortWithinPartitions("print"), f"run-{k + 1}")
        write_text(self.spark, f"{scratch.path}/index.json", json.dumps(state))
        self.state = state
        scratch.drop(*old)

    def _merged(self, runs: list[str]) -> DataFrame:
        rows = self._read(runs, RUN)
        return rows if len(runs) == 1 else rows.groupBy("print").agg(F.least(F.sum("places"), F.lit(2).cast("long")).alias("places"), F.min("first").alias("first"))

    def passages(self) -> DataFrame:
        """doc_id, n_words, n_removed and kept_sha256 for every row of all batches, judged on all of them."""
        size, gram = self.size, self.gram
        scratch = Scratch(self.spark, "substring-passages", batch_rows=1000)
        texts = self._read([f"texts-{k}" for k in self.state["batches"]], TEXTS)
        hits = self._read([f"hits-{k}" for k in self.state["batches"]], "row long, print long").groupBy("row").agg(F.collect_set("print").alias("hot"))
        found = texts.select("row", "text").join(hits.hint("merge"), "row", "left").select("row", "text", "hot").mapInArrow(lambda b: candidates(b, size, gram), FOUND)
        found = scratch.put(found, "found")

        # Equal stretches become one class; one stretch of it is opened into windows, which count twice if the class has more.
        hot = found.filter("kept_sha256 is null")
        stretches = hot.select("row", F.explode(F.arrays_zip("at", "size", "s1", "s2")).alias("x")).select("row", "x.*")
        classes = stretches.groupBy("s1", "s2").agg(F.count("*").alias("n"), F.min(F.struct("row", "at", "size")).alias("own"))
        classes = scratch.put(classes, "classes")
        weight = F.when(F.col("n") > 1, 2).otherwise(1).alias("weight")
        opening = classes.select("own.*", weight).groupBy("row").agg(F.collect_list(F.struct("at", "size", "weight")).alias("stretches"))
        single = texts.select("row", "text").join(opening.hint("merge"), "row").mapInArrow(lambda b: opened(b, size), WINDOWS)
        single = scratch.put(single, "windows")
        repeats = scratch.put(single.groupBy("w1", "w2").agg(F.sum("weight").alias("n")).filter("n > 1").select("w1", "w2"), "repeats")
        again = single.filter("weight = 1").join(repeats.hint("merge"), ["w1", "w2"]).select("row", "at", F.lit(1).alias("size"))
        whole = stretches.join(classes.filter("n > 1").select("s1", "s2").hint("merge"), ["s1", "s2"]).select("row", "at", "size")
        covered = scratch.put(whole.unionByName(again).groupBy("row").agg(F.collect_list(F.struct("at", "size")).alias("cover")), "covered")
        scratch.drop("classes", "windows", "repeats")
        scratch.release()
        clean = texts.select("row", "doc_id").join(found.filter("kept_sha256 is not null").select("row", "n_words", "kept_sha256").hint("merge"), "row")
        clean = clean.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
        marked = texts.join(hot.select("row", "n_words").hint("merge"), "row").join(covered.hint("merge"), "row", "left")
        return clean.unionByName(marked.select("doc_id", "text", "cover", "n_words").mapInArrow(lambda b: removed(b, size), OUT))


def repeated_passages(docs: DataFrame, size: int = SIZE, gram: int = GRAM, batches: int = BATCHES, fan: int = FAN) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of docs (doc_id, text, ...)."""
    index = FingerprintIndex(docs.sparkSession, size=size, gram=gram, fan=fan)
    for k in range(batches):
        index.add(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    return index.passages()
