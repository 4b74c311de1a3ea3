"""Near-duplicate documents by min-max hashing.

Every permutation of a document's shingle hashes gives two values, its minimum
and its maximum, so a signature of 96 values costs 48 evaluations.  A band is
the four values of two permutations, and 24 bands make the candidates: at a
similarity of 0.85 a band agrees with a probability of about 0.52, and all 24
miss with one below 1e-7.

Texts with the same words become one class, by a 128-bit BLAKE2b digest of the
words, and one row of it goes on.  Buckets with the same members are compared
once.  Pairs are found by 64-bit shingle hashes and every link is confirmed on
the shingles themselves, so no collision of hashes links two texts.

A bucket of more than ``BLOCK`` members is cut into blocks, and the bucket's
smallest row, its leader, and ``PIVOTS`` other members go to each block: that
joins the blocks of a group of near copies.  Then only the members that their
block did not connect to the leader are compared with the bucket's other blocks.
So every pair of a bucket is compared or already connected, and a task holds two
blocks at most.  Each task returns a spanning forest of its links, never all
pairs.  Components come from alternating large and small stars.

Defined cases: null or empty text has no shingles, stays its own component and
links with nothing; a text of one to four words has its whole sequence as its
only shingle; rows that repeat a doc_id are texts of their own; a null doc_id has
a null component, is kept and links nothing.  Other columns are ignored, an empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import U, Words, buffers, digest, mix, spans, stream, windows, within
from .work import Scratch, is_empty

SIZE, BANDS, BLOCK, PIVOTS = 5, 24, 256, 8
SIGNED = "row long, doc_id long, n_shingles long, k1 long, k2 long, bands array<long>"
#: Rows a and b are connected; or, with b null, a row that the bucket's leader is not connected to in its block.
LINKS = "a long, b long, band int, key long"


def shingle_sets(words: Words, data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, text after text, and where each text's begin."""
    starts, ends, first = words.borders(data, offsets)
    hashes = words.hashes(data, starts, ends)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, n > 0)
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(at[-1], dtype=np.uint64)
    out[np.repeat(n >= size, count)] = windows(hashes, size, 21)[within(first, size, len(hashes))]
    for d in np.flatnonzero((n > 0) & (n < size)):
        out[at[d]] = windows(hashes[first[d] : first[d + 1]], int(n[d]), 900 + int(n[d]))[0]
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[at[:-1][count > 0]] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[at]


def shingles(words: list[bytes], size: int = SIZE) -> set[bytes]:
    """The shingles of a text's words themselves."""
    if len(words) < size:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}


def signed(batches: Iterator[pa.RecordBatch], size: int, bands: int) -> Iterator[pa.RecordBatch]:
    words = Words(11, lower=True)
    factor, shift = stream(31, 2 * bands) | U(1), stream(32, 2 * bands)
    weight = stream(34, 4) | U(1)
    for batch in batches:
        data, offsets = buffers(batch.column(2))
        for i, j in spans(offsets):
            part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            sets, at = shingle_sets(words, part, off, size)
            n = np.diff(at)
            full = np.flatnonzero(n)
            keys = np.zeros((len(full), bands), dtype=np.uint64)
            own = np.frombuffer(b"".join([digest(b" ".join(part[a:b].tobytes().lower().split())) for a, b in zip(off[:-1], off[1:])]), dtype="<i8")
            if len(full):
                heads = at[:-1][full]
                for band in range(bands):
                    key = np.zeros(len(full), dtype=np.uint64)
                    for k in range(2):
                        x = sets * factor[2 * band + k]
                        x += shift[2 * band + k]
                        key += np.minimum.reduceat(x, heads) * weight[2 * k] + mix(np.maximum.reduceat(x, heads)) * weight[2 * k + 1]
                    keys[:, band] = mix(key)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n.astype(np.int64)), pa.array(own[0::2]), pa.array(own[1::2]), lists], names=["row", "doc_id", "n_shingles", "k1", "k2", "bands"])


def forest(sets: list[np.ndarray], percent: int, confirmed: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union, by hashes, that ``confirmed`` allows."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(0, 1)] if 100 * both >= percent * (size.sum() - both) and confirmed(0, 1) else []
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), size)[np.argsort(ids, kind="stable")]
    begin = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    at = np.concatenate([[0], np.cumsum(size)])
    waiting, edges = np.ones(m, dtype=bool), []
    for root in range(m):
        if not waiting[root]:
            continue
        waiting[root] = False
        front = [root]
        while front and waiting.any():
            i = front.pop()
            mine = ids[at[i] : at[i + 1]]
            n = begin[mine + 1] - begin[mine]
            step = np.repeat(begin[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            both = np.bincount(owner[np.arange(n.sum()) + step], minlength=m)
            linked = [k for k in np.flatnonzero(waiting & (100 * both >= percent * (size + size[i] - both))).tolist() if confirmed(i, k)]
            waiting[linked] = False
            edges += [(i, k) for k in linked]
            front += linked
    return edges


def trees(m: int, edges: list[tuple[int, int]]) -> list[int]:
    """The smallest member that each member of a forest is connected to."""
    top = list(range(m))

    def root(k: int) -> int:
        while top[k] != k:
            top[k] = top[top[k]]
            k = top[k]
        return k

    for p, q in edges:
        a, b = root(p), root(q)
        top[max(a, b)] = min(a, b)
    return [root(k) for k in range(m)]


def links(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Connections in each run of rows with one group (band, key, lo, hi), sorted by it and by row: each row to the
    smallest that it is linked to in the group, directly or not; with a leader also who is apart from it."""
    words = Words(11, lower=True)
    held: pa.Table | None = None

    def linked(table: pa.Table, cuts: list[int]) -> pa.RecordBatch:
        data, offsets = buffers(table.column("text"))
        ids, leaders, bands, keys = (table.column(c).to_numpy() for c in ("row", "leader", "band", "key"))
        sets: list[np.ndarray] = []
        for i, j in spans(offsets):
            s, at = shingle_sets(words, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            sets += [s[a:b] for a, b in zip(at[:-1], at[1:])]
        found, apart = set(), []
        for a, b in zip(cuts[:-1], cuts[1:]):
            some = [k for k in range(a, b) if k == a or ids[k] != ids[k - 1]]  # a row can come with both blocks
            if len(some) < 2:
                continue
            real: dict[int, set[bytes]] = {}

            def of(k: int) -> set[bytes]:
                if k not in real:
                    real[k] = shingles(data[offsets[some[k]] : offsets[some[k] + 1]].tobytes().lower().split(), size)
                return real[k]

            def confirmed(x: int, y: int) -> bool:
                one, two = of(x), of(y)
                both = len(one & two)
                return 100 * both >= percent * (len(one) + len(two) - both)

            roots = trees(len(some), forest([sets[k] for k in some], percent, confirmed))
            found.update((int(ids[some[r]]), int(ids[some[k]])) for k, r in enumerate(roots) if r != k)
            if leaders[a] >= 0:
                first = next(k for k, x in enumerate(some) if ids[x] == leaders[a])
                apart += [(int(ids[some[k]]), None, int(bands[a]), int(keys[a])) for k, r in enumerate(roots) if r != roots[first]]
        rows = [(x, y, None, None) for x, y in found] + apart
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["a", "b", "band", "key"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("band", "key", "lo", "hi")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist()]
        if len(cuts) > 1:
            yield linked(table.slice(0, cuts[-1]), cuts)
        held = table.slice(cuts[-1])
    if held is not None and held.num_rows:
        yield linked(held, [0, held.num_rows])


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(v, component) for every end of an edge (a, b); component: the smallest id that can be reached."""

    def stars(edges: DataFrame, name: str, large: bool) -> DataFrame:
        """Each larger neighbour (or, for small stars, each smaller one and the centre) to the smallest of all."""
        from_, to = F.col("u"), F.col("v")
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        near = near.union(edges.select("b", "a")) if large else near.select(F.greatest(from_, to).alias("u"), F.least(from_, to).alias("v"))
        low = scratch.put(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        moved = near.join(low, "u").filter(to > from_ if large else to != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.union(low.filter("u <> m").select("u", "m"))
        return scratch.put(moved.filter("a <> b").distinct(), name)

    def finished(edges: DataFrame) -> bool:
        """Every end a has one b, and no b is an a: the edges are stars around their smallest ids."""
        ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("n")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("n")).distinct())
        return is_empty(ends.groupBy("v").agg(F.count("*").alias("k"), F.sum("n").alias("n")).filter("n > 0 and k > 1"))

    k = 0
    edges = stars(edges, "small-0", False)
    while not finished(edges):
        k += 1
        edges = stars(stars(edges, f"large-{k}", True), f"small-{k}", False)
    return edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("component")).unionByName(edges.select(F.col("b").alias("v"), F.col("b").alias("component")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 85, size: int = SIZE, bands: int = BANDS, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text, ...)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup", batch_rows=1000)
    texts = scratch.put(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "rows")
    sign = scratch.put(texts.mapInArrow(lambda b: signed(b, size, bands), SIGNED), "signed")
    words = ["k1", "k2"]
    known = sign.filter("doc_id is not null and n_shingles > 0")
    classes = scratch.put(known.groupBy(*words).agg(F.min("doc_id").alias("doc"), F.min("row").alias("row")), "classes")
    heads = scratch.put(known.select("row", "bands").join(classes.select("row").hint("merge"), "row"), "heads")
    banded = heads.select("row", F.posexplode("bands").alias("band", "key"))
    counts = banded.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("row").alias("x0"), F.max("row").alias("x1"), F.bit_xor(F.xxhash64("row")).alias("x2"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("x3")).filter("n > 1")
    buckets = scratch.put(counts.groupBy("n", "x0", "x1", "x2", "x3").agg(F.min(F.struct("band", "key")).alias("own")).select("own.*", "n", "x0"), "buckets")
    many = F.ceil(F.col("n") / block)
    members = banded.join(buckets.hint("merge"), ["band", "key"]).select("band", "key", "row", "n", many.alias("many"), F.when(many > 1, F.col("x0")).otherwise(-1).alias("leader"))
    members = scratch.put(members.withColumn("own", F.pmod(F.xxhash64("row"), F.col("many"))), "members")
    inside = scratch.put(texts.select("row", "text").join(members.select("row").distinct().hint("merge"), "row", "left_semi"), "inside")
    scratch.drop("heads", "buckets", "rows")

    def linked(groups: DataFrame, name: str) -> DataFrame:
        """Links in groups: band, key, lo, hi, leader and row."""
        by = ("band", "key", "lo", "hi")
        rows = groups.join(inside.hint("merge"), "row").repartition(*by).sortWithinPartitions(*by, "row")
        return scratch.put(rows.select(*by, "leader", "row", "text").mapInArrow(lambda b: links(b, size, percent), LINKS), name)

    everywhere = (F.col("many") > 1) & ((F.col("row") == F.col("leader")) | (F.pmod(F.xxhash64("row", F.lit(2)), F.col("n")) < pivots))
    every = F.sequence(F.lit(0).cast("long"), F.col("many") - 1)
    blocks = members.select("band", "key", F.explode(F.when(everywhere, every).otherwise(F.array("own"))).alias("lo"), F.lit(0).cast("long").alias("hi"), "leader", "row")
    first = linked(blocks, "links")
    apart = scratch.put(first.filter("b is null").select("band", "key", F.col("a").alias("row")).distinct(), "apart")
    sizes = apart.groupBy("band", "key").agg(F.count("*").alias("r"))
    whole = members.filter("many > 1").select("band", "key", "n", "row").join(sizes.hint("merge"), ["band", "key"])
    whole = whole.join(apart.withColumn("apart", F.lit(True)).hint("merge"), ["band", "key", "row"], "left")
    # The apart in blocks against each other (lo < hi), and against blocks of the connected (hi < 0).
    blocks_of = lambda n: F.ceil(n / block)
    whole = whole.select("band", "key", "row", "apart", blocks_of(F.col("r")).alias("aparts"), blocks_of(F.col("n") - F.col("r")).alias("others"), F.xxhash64("row", F.lit(3)).alias("h"))
    zero = F.lit(0).cast("long")
    upto = lambda n: F.when(n > 0, F.sequence(zero, n - 1)).otherwise(F.array().cast("array<bigint>"))
    own, other = F.pmod("h", "aparts"), F.pmod("h", "others")
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    with_apart = F.when(F.col("aparts") == 1, F.array(pair(zero, zero))).otherwise(F.transform(F.filter(upto(F.col("aparts")), lambda q: q != own), lambda q: pair(F.least(own, q), F.greatest(own, q))))
    with_others = F.transform(upto(F.col("others")), lambda j: pair(own, -1 - j))
    groups = F.when(F.col("apart"), F.concat(with_apart, with_others)).otherwise(F.transform(upto(F.col("aparts")), lambda p: pair(p, -1 - other)))
    rest = whole.select("band", "key", F.explode(groups).alias("g"), "row").select("band", "key", "g.lo", "g.hi", F.lit(-1).cast("long").alias("leader"), "row")
    found = scratch.put(first.filter("b is not null").select("a", "b").unionByName(linked(rest, "links-apart").select("a", "b")).distinct(), "found")
    scratch.drop("members", "inside", "apart", "links", "links-apart")
    scratch.release()
    reached = None if is_empty(found) else scratch.put(components(scratch, found), "components")
    joined = classes
    if reached is not None:
        # The smallest id of each component's classes.
        named = scratch.put(joined.join(reached.withColumnRenamed("v", "row").hint("merge"), "row"), "named")
        low = named.groupBy("component").agg(F.min("doc").alias("low"))
        low = named.select(*words, "component").join(low.hint("merge"), "component").select(*words, "low")
        joined = joined.join(low.hint("merge"), words, "left").withColumn("doc", F.coalesce("low", "doc"))
    joined = scratch.put(joined.select(*words, F.col("doc").alias("component")), "joined")
    out = sign.drop("bands", "row").join(joined.hint("merge"), words, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
