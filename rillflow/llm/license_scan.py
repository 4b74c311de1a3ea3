"""Licence notices by a positional rare-token index.

The index holds, for each licence word, its postings (template, position), and
its inverse document frequency over the whole corpus, counted in a first pass.
A file's licence words are taken from the highest IDF down.  Each is looked up
for the templates whose key phrases the file can hold, by their words; a template
starts with the relative positions (shifts) of its first such word and keeps
those in which the next ones agree, ``RARE`` words in all.  At the shifts that
are left its mandatory key phrase is verified word by word, and then the share
of the template's IDF weight that stands there.  A true occurrence agrees in all
of its words, so none is lost.

Fixed values: the three base phrases and their labels.

Defined cases: null or empty text has no words, labels are the empty string,
first and last word null, score 0.  Rows and ids may repeat or be null.  Other
columns are ignored, an empty table gives none.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Label, mandatory key phrase, and the longer notice around it.
OWN = [
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "gnu general public license version 3", "licensed under the gnu general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "licensed under the gnu general public license version 2"),
    ("gpl", "gnu general public license", "terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "terms of the gnu lesser general public license"),
    ("agpl-3", "gnu affero general public license", "terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("mpl-2", "mozilla public license", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "creative commons attribution", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal public domain dedication"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
]
RARE, SHARE = 3, 0.6
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
#: Bytes that are no part of a word become spaces, A to Z become a to z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


class Templates:
    """Postings of the licence words, and which words look each template up."""

    def __init__(self, idf: dict[bytes, float]):
        self.items = [(label, phrase.encode().split(), phrase.encode().split(), True) for label, phrase in BASE]
        for label, key, notice in OWN:
            own = notice.encode().split()
            self.items.append((label, key.encode().split(), own, False))
        self.idf = idf
        #: word: (template, its places in the key phrase)
        self.postings: dict[bytes, list[tuple[int, list[int]]]] = {}
        self.key_at: list[int] = []
        self.need: list[frozenset[bytes]] = []
        marks = set()
        for t, (_, key, notice, _) in enumerate(self.items):
            at = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
            self.key_at.append(at)
            self.need.append(frozenset(key))
            for w in set(key):
                self.postings.setdefault(w, []).append((t, [at + i for i, x in enumerate(key) if x == w]))
            marks.add(min(key, key=lambda w: (-idf[w], w)))
        #: Every key phrase holds one of these.
        self.marks = [b" " + w + b" " for w in sorted(marks)]

    @staticmethod
    def vocabulary() -> list[bytes]:
        return sorted({w for _, p in BASE for w in p.encode().split()} | {w for _, k, n in OWN for w in (k + " " + n).encode().split()})

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[str, float]]:
        """Places (template, start) of base phrases, and each label's score."""
        places: dict[bytes, list[int]] = {}
        for d, word in enumerate(words):
            if word in self.postings:
                places.setdefault(word, []).append(d)
        shifts: dict[int, set[int]] = {}
        open_ = {t: min(RARE, len(n)) for t, n in enumerate(self.need) if all(w in places for w in n)}
        for word in sorted(places, key=lambda w: (-self.idf[w], w)):
            if not any(open_.values()):
                break
            for t, at in self.postings[word]:
                if open_.get(t):
                    open_[t] -= 1
                    agree = {d - i for d in places[word] for i in at}
                    shifts[t] = shifts[t] & agree if t in shifts else agree
        base, scores = [], {}
        for t, shift in sorted((t, x) for t, found in shifts.items() for x in found):
            label, key, notice, is_base = self.items[t]
            at = shift + self.key_at[t]
            if at < 0 or words[at : at + len(key)] != key:
                continue
            if is_base:
                base.append((t, at))
                scores[label] = 1.0
                continue
            there = sum(self.idf[w] for i, w in enumerate(notice) if 0 <= shift + i < len(words) and words[shift + i] == w)
            share = there / sum(self.idf[w] for w in notice)
            if share >= SHARE:
                scores[label] = max(scores.get(label, 0.0), share)
        return base, scores


def counted(batches: Iterator[pa.RecordBatch], vocabulary: list[bytes]) -> Iterator[pa.RecordBatch]:
    """Documents, and documents that hold each licence word; one batch a task."""
    known, df, n = set(vocabulary), Counter(), 0
    for batch in batches:
        for text in batch.column(0):
            n += 1
            df.update(known.intersection(words_of(text.as_py())))
    words = [w.decode() for w in df]
    yield pa.RecordBatch.from_arrays([pa.array([*words, None], pa.string()), pa.array([*df.values(), n], pa.int64())], names=["word", "n"])


def corpus_idf(texts: DataFrame) -> dict[bytes, float]:
    """IDF of the licence words, a fixed number of them, over all documents."""
    vocabulary = Templates.vocabulary()
    rows = texts.mapInArrow(lambda b: counted(b, vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r.word: r.n for r in rows}
    return {w: math.log((1 + df.get(None, 0)) / (1 + df.get(w.decode(), 0))) + 1 for w in vocabulary}


def scanned(batches: Iterator[pa.RecordBatch], idf: dict[bytes, float]) -> Iterator[pa.RecordBatch]:
    templates = Templates(idf)
    for batch in batches:
        out = []
        for text in batch.column(1):
            words = words_of(text.as_py())
            line = b" " + b" ".join(words) + b" "
            if not any(m in line for m in templates.marks):
                out.append((len(words), 0, None, None, "", "", 0.0))
                continue
            base, scores = templates.find(words)
            starts = [at for _, at in base]
            own = sorted({templates.items[t][0] for t, _ in base})
            out.append((len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(sorted(scores)), max(scores.values(), default=0.0)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score for every row."""
    idf = corpus_idf(docs.select("text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: scanned(b, idf), SCHEMA)
