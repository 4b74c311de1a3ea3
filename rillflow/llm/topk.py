"""Exact top-k search by inner product, with a pivot-distance index.

Adding one component, sqrt(M - |x|^2) with M the largest squared norm, puts all
vectors on one sphere: a larger inner product with a query is then a smaller
distance.  Each vector is keyed by its nearest pivot and its distance to it, and
the index is a table sorted by that key, in even ranges, so neither a popular
pivot nor a vector that many rows share makes a large partition.  A query block
walks the annuli of each range from the nearest outwards, and by the triangle
inequality stops where no closer vector can follow.  Bounds start from the k-th
best score over the pivots' own rows.

Queries go out in blocks of ``QUERIES`` at the most by hash, one pass over the
index for each; each task sends its k best for each query, never all pairs.
Vectors are whole numbers, floor(256 x).  Scores are exact: products of doubles
while the largest squared norm is below 2**53, of 64-bit integers below 2**62;
beyond that a score may leave 64 bits, which is an error.

Pivots are a documented bounded sample: the ``PIVOTS`` rows with the smallest
hash of their id.  All rows are indexed.

Defined cases: a vector that is null, empty, or holds null or non-finite
components takes no part; so does one of another length than a query's, for that
query.  Rows that share a query's id are its own; queries that share an id are
one, with the best scores of any of their vectors, a row counted once for each.  Repeated rows under other ids
are candidates each; a null id is no query and no candidate.  An empty table
gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Scratch

PIVOTS, QUERIES, ANNULUS = 64, 2048, 512


def whole_numbers(frame: DataFrame) -> DataFrame:
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * 256))
    good = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    return frame.filter(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def keyed(batches: Iterator[pd.DataFrame], pivots: np.ndarray, most: float) -> Iterator[pd.DataFrame]:
    """Nearest pivot and distance to it, on the sphere."""
    for batch in batches:
        x = np.array(batch["v"].tolist(), dtype=np.float64).reshape(len(batch), -1)
        norm = (x * x).sum(axis=1)
        last = np.sqrt(np.maximum(most - norm, 0))
        square = np.maximum(2 * most - 2 * (x @ pivots[:, :-1].T + last[:, None] * pivots[:, -1]), 0)
        batch["pivot"] = square.argmin(axis=1).astype(np.int32)
        batch["distance"] = np.sqrt(square[np.arange(len(batch)), batch["pivot"]])
        yield batch[["vec_id", "v", "pivot", "distance"]]


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def products(q: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers held as doubles, as 64-bit integers."""
    return np.rint(q @ x.T).astype(np.int64) if most < 2.0**53 else q.astype(np.int64) @ x.astype(np.int64).T


def searched(batches: Iterator[pd.DataFrame], q_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, most: float, floor: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """Each query's k best rows of a sorted range of the index, by sorted annuli."""
    norm = (q * q).sum(axis=1)
    # The query lies on the sphere's equator: its added component is 0, its norm its own.
    far = np.sqrt(np.maximum(norm[:, None] + most - 2 * q @ pivots[:, :-1].T, 0))
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    least, widest = floor.copy(), max(most, float(norm.max()))
    for batch in batches:
        x = np.array(batch["v"].tolist(), dtype=np.float64).reshape(len(batch), -1)
        ids, pivot, distance = (batch[c].to_numpy() for c in ("vec_id", "pivot", "distance"))
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(pivot)) + 1, np.arange(0, len(ids), ANNULUS), [len(ids)]]))
        rings = [(int(a), int(b)) for a, b in zip(cuts[:-1], cuts[1:])]
        # Smallest distance that a row of each annulus can have to each query; a hair is left for rounding.
        own = np.array([pivot[a] for a, _ in rings])
        low, high = np.array([distance[a:b].min() for a, b in rings]), np.array([distance[a:b].max() for a, b in rings])
        near = np.maximum(np.maximum(far[:, own] - high, low - far[:, own]), 0)
        bound = (norm[:, None] + most - near * near) / 2 + 1e-6 * (1 + most)
        closest = near.min(axis=0)
        top_bound = (norm.max() + most - closest * closest) / 2 + 1e-6 * (1 + most)
        for r in np.argsort(closest, kind="stable"):
            if top_bound[r] < least.min():
                break  # no annulus from here on can hold a row for any query
            a, b = rings[r]
            open_ = np.flatnonzero(bound[:, r] >= least)
            if not len(open_):
                continue
            scores = products(q[open_], x[a:b], widest)
            scores[ids[a:b][None, :] == q_ids[open_][:, None]] = np.iinfo(np.int64).min
            for row, s in zip(open_, scores):
                new = np.flatnonzero((s >= least[row]) & (s > np.iinfo(np.int64).min))
                if len(new):
                    i, v = np.concatenate([kept[row][0], ids[a:b][new]]), np.concatenate([kept[row][1], s[new]])
                    top = best(i, v, k)
                    kept[row] = (i[top], v[top])
                    if len(top) == k:
                        least[row] = max(least[row], v[top][-1])
    yield pd.DataFrame({"query_id": np.repeat(q_ids, [len(i) for i, _ in kept]), "vec_id": np.concatenate([i for i, _ in kept]), "score": np.concatenate([v for _, v in kept])})


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score: the k largest inner products of each query with all rows but its own."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "top-k")
    schema = "query_id long, vec_id long, score long"
    vectors = scratch.put(whole_numbers(rows), "vectors")
    asked = scratch.put(whole_numbers(queries).dropDuplicates(), "queries")
    parts: list[DataFrame] = []
    for (length,) in [r for r in asked.select(F.size("v")).distinct().sort(F.size("v")).collect()]:
        own = vectors.filter(F.size("v") == length)
        squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
        most, n = own.agg(F.max(squares), F.count("*")).first()
        if not n:
            continue
        most = float(most)
        sample = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(pivots, 16 * k)).collect()
        seen = np.array([r.v for r in sample], dtype=np.float64).reshape(len(sample), -1)
        seen_ids = np.array([r.vec_id for r in sample])
        chosen = seen[:pivots]
        chosen = np.hstack([chosen, np.sqrt(np.maximum(most - (chosen * chosen).sum(axis=1), 0))[:, None]])
        shape = "vec_id long, v array<long>, pivot int, distance double"
        index = own.mapInPandas(lambda b, p=chosen, m=most: keyed(b, p, m), shape)
        index = scratch.put(index.repartitionByRange("pivot", "distance", "vec_id").sortWithinPartitions("pivot", "distance", "vec_id"), f"index-{length}")
        mine = asked.filter(F.size("v") == length)
        if max(most, mine.agg(F.max(squares)).first()[0]) >= 2.0**62:
            raise ValueError("vectors too large: an inner product may not fit 64 bits")
        passes = -(-mine.count() // block)
        for p in range(passes):
            some = mine.filter(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).collect()
            if not some:
                continue
            q_ids, q = np.array([r.vec_id for r in some]), np.array([r.v for r in some], dtype=np.float64).reshape(len(some), -1)
            scores = products(q, seen, max(most, float((q * q).sum(axis=1).max())))
            floor = [np.sort(s[seen_ids != i])[-k] if (seen_ids != i).sum() >= k else np.iinfo(np.int64).min for i, s in zip(q_ids, scores)]
            sent = spark.sparkContext.broadcast((q_ids, q, chosen, most, np.array(floor, dtype=np.int64)))
            parts.append(index.mapInPandas(lambda b, s=sent: searched(b, *s.value, k), schema))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    ranked = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k).alias("top"))
    return ranked.select("query_id", F.posexplode("top").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score"))
