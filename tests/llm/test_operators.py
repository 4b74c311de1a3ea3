"""Every operator against a plain version, on a small table and on the cases that its docstring defines."""

import random

import pytest
from pyspark.sql import functions as F

from rillflow.llm import bpe, exact_dedup, license_scan, near_dup, packing, pii, quality, queries, substring, token_store, tokenizer_files, topk
from rillflow.llm.work import Scratch

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digit string, low int, n int, rest int, ids int, label int, spans int, at int, shard int"
COMMON = " ".join("the quick brown fox jumps over a lazy dog number %d" % k for k in range(9))


def odd_rows():
    rng = random.Random(5)
    text = lambda n, of=400: " ".join(f"w{rng.randrange(of)}" for _ in range(n))
    long = text(30_000, 20_000)
    base = text(80, 10_000)
    texts = [None, "", " ", "\n\t ", "a", "A b", "a  b", "a\tb ", " lead", "x" * 5000, "é ü ß 漢字 🙂" * 9, long, long + " more", base, base, base + " tail", "head " + base, base.upper()]
    texts += [text(50) + " " + COMMON + " " + text(30), COMMON, "To " * 300, "a b " * 60, "don't  stop\r\n\r\n we'll\x1cgo <|endoftext|>"]
    texts += ["<|endoftext|>start", "in<|endoftext|>side <|endoftext|><|endoftext|> a <|endof<|endoftext|>text|> b", " <|endoftext|> "]
    texts += ["Released under the MIT License. under the mit license", "CC BY NC by nc cc by-nc", "GNU General Public License, version 3 licensed under the GNU General Public License version 3", "mail x.y@a-b.example.com and a@b@c.d, 1.2.3.4.5.6.7.8 999.1.1.1 007.08.1.2"]
    texts += ["card 4111 1111 1111 1111 or 4111-1111-1111-1112 5500000000000004", "call +1 (988) 555-2485. or +44 20 7946 0958) +1((((", "@@ a@b. .@x.y +12"]
    texts += [base.replace("w1", "v1", 1), text(3), text(4), text(5)]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3, 4, 5, 6, 7, 8) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    table = [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    return odd_rows() + table


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def repeated(spark):
    """Repeated rows, one id for two texts, and null ids."""
    return frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "other text"), (None, "a b c d e f"), (None, None), (None, "only null")])


def collected(frame):
    return [tuple(r) for r in frame.collect()]


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def test_licences(docs, rows, empty, repeated):
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    for i, text in rows:
        assert tuple(got[i])[1:6] == brute.licence(text), i
    by = {t: i for i, t in odd_rows() if t}
    assert [r.labels for t, i in by.items() if t.startswith("GNU") for r in [got[i]]] == ["gpl-3"]
    assert all(0 <= r.score <= 1 for r in got.values()) and all((r.score > 0) == bool(r.labels) for r in got.values())
    assert collected(license_scan.scan(empty)) == [] and license_scan.scan(repeated).count() == 7


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], 0) for i in range(400)] + [(400 + i, [0.5] * 6, 0) for i in range(300)]
    rows += [(1000, None, 0), (1001, [], 0), (1002, [float("nan")] * 6, 0), (1003, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 0), (1004, [float("inf")] * 6, 0), (1050, [1.0, 2.0], 0), (1100, [2.0, 1.0], 0), (None, [1.0] * 6, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = collected(topk.top_k(frame, frame.filter("vec_id % 50 = 0"), pivots=8, block=5))
    import math

    import numpy as np

    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in whole:
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    same(got, want)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert collected(topk.top_k(none, none)) == []


def test_top_k_of_large_components(spark):
    """Scores beyond 2**53 are those of Python's integers; those that may leave 64 bits are refused."""
    rng = random.Random(3)
    rows = [(i, [float(rng.randrange(-1_000_000, 1_000_000)) for _ in range(40)]) for i in range(60)]
    rows += [(100 + i, rows[i][1][:-1] + [rows[i][1][-1] + 1.0]) for i in range(20)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [256 * int(x) for x in v] for i, v in rows}
    want = []
    for q in (0, 50, 100):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scores[:5])]
    assert max(s for *_, s in want) > 2**53
    same(collected(topk.top_k(frame, frame.filter("vec_id % 50 = 0"), pivots=4)), want)
    with pytest.raises(ValueError):
        topk.top_k(frame.withColumn("embedding", F.transform("embedding", lambda x: x * 1e6)), frame.limit(1))


def test_near_duplicates(docs, rows, empty, repeated):
    want = brute.near(rows)
    for block in (512, 3):
        got = {r.doc_id: r for r in near_dup.near_duplicates(docs, block=block).collect()}
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert collected(near_dup.near_duplicates(empty)) == []
    same(collected(near_dup.near_duplicates(repeated).select("doc_id", "component_id")), [(1, 1), (1, 1), (2, 1), (2, 2), (None, None), (None, None), (None, None)])


def test_near_duplicates_in_a_chain(spark):
    """Links between neighbours alone, in one component."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[5 * i : 5 * i + 200])) for i in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near(rows) and {c for _, c in got.values()} == {0}


def test_packing(docs, rows, empty, repeated):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files.path(tokenizer_files.IDS))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in rows}
    pieces, sequences = {}, {}
    for r in packing.pack(docs, shard=20).collect():
        ids = [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
        assert len(ids) == r.length > 0 and r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert {i: [x for _, p in sorted(ps) for x in p] for i, ps in pieces.items()} == want
    for parts in sequences.values():
        ends = [0]
        for offset, length in sorted(parts):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] == 2048 or ends[-1] & (ends[-1] - 1) == 0 and ends[-1] < 2048
    assert collected(packing.pack(empty)) == [] and packing.pack(repeated).count() >= 7


def test_neighbours_share_words():
    import numpy as np

    rng = np.random.default_rng(0)
    docs = [rng.integers(100 * (k % 2), 100 * (k % 2) + 100, 60) for k in range(20)]
    scores = packing.Index(docs, common=1.0).scores(0)
    assert min(scores[2::2]) > max(scores[1::2])


def test_ids_that_many_documents_hold_are_scored():
    import numpy as np

    rng = np.random.default_rng(4)
    shared = rng.integers(0, 100, 80)
    docs = [np.concatenate([shared, rng.integers(1000, 9000, 20)]) if k < 10 else rng.integers(200, 900, 100) for k in range(30)]
    index, n = packing.Index(docs), len(docs)
    mean = sum(map(len, docs)) / n
    for seed in (0, 5, 12):
        want = np.zeros(n)
        for t in set(docs[seed].tolist()):
            df = sum(t in d for d in docs)
            for k, d in enumerate(docs):
                tf = (d == t).sum()
                want[k] += (df > 1) * np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        assert np.allclose(index.scores(seed), want)
    assert min(index.scores(0)[:10]) > max(index.scores(0)[10:])


def apart(count, gap):
    """Pairs of near copies, ``gap`` rows between their halves, with equal lengths."""
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(100)) for _ in range(count)]
    return [(k, t) for k, t in enumerate(texts + [t.replace("w1", "v1", 1) for t in texts])][: count + gap]


def test_packing_counts_over_the_whole_corpus(spark, docs, rows):
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files.path(tokenizer_files.IDS))
    texts = [[*t.encode(x or "", add_special_tokens=False).ids, 1] for _, x in rows]
    rests = [x[len(x) // 2048 * 2048 :] for x in texts]
    file, pattern, cut = tokenizer_files.library_file(spark), tokenizer_files.pattern(), packing.cut
    pieces = docs.select("doc_id", "text").repartition(5).mapInArrow(lambda b: cut(b, file.value, pattern, 2048), packing.CUT)
    stats = packing.corpus_stats(pieces)
    assert stats.mean == pytest.approx(sum(map(len, rests)) / sum(map(bool, rests)))
    for term in {x for ids in texts for x in ids}:
        df = sum(term in set(ids) for ids in texts) if term % 50 == 1 else None
        assert df is None or stats.idf[term] == pytest.approx(np.log1p((len(texts) - df + 0.5) / (df + 0.5)))
    index, own = packing.Index([np.array(x) for x in rests[-40:]], stats=stats), [set(x) for x in rests[-40:]]
    want = 0.0
    for term in own[3] & own[7]:
        tf = rests[-33].count(term)
        want += stats.idf[term] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(rests[-33]) / stats.mean))
    assert index.scores(3)[7] == pytest.approx(want)


def test_packing_finds_neighbours_anywhere_in_the_table(spark):
    """Near copies lie 400 rows apart, shards have 40 rows; in file order no pair would share one."""
    table = frame(spark, apart(400, 400)).coalesce(1)
    sequences = {}
    for r in packing.pack(table, shard=40).collect():
        sequences.setdefault(r.doc_id, set()).add(r.sequence_id)
    together = sum(any(abs(a - b) <= 1 for a in sequences[k] for b in sequences[k + 400]) for k in range(400))
    assert together >= 320


def test_packing_splits_a_group_of_copies(spark):
    """A third of all rows is one text: its shards are as large as others, every row is packed once."""
    import numpy as np

    table = apart(300, 0) + [(1000 + k, "the same words again " * 20) for k in range(150)]
    pieces = packing.pack(frame(spark, table), shard=16).collect()
    assert sorted(r.doc_id for r in pieces if r.start == 0) == sorted(i for i, _ in table)
    same(sorted({i: 0 for i, _ in table}.items()), sorted((i, t - n) for i, t, n in {(r.doc_id, r.doc_tokens, sum(p.length for p in pieces if p.doc_id == r.doc_id)) for r in pieces}))
    stats = packing.Stats.of(np.array([3, 5]), np.array([2, 1]), 9, 4.0)
    assert stats.route(np.array([3, 5, 5])) == stats.route(np.array([5, 3])) != stats.route(np.array([5]))


def test_pii(docs, rows, empty, repeated):
    got = {r.doc_id: r for r in pii.extract(docs).select("*", pii.as_text(F.col("base")).alias("b"), pii.as_text(F.col("spans")).alias("s")).collect()}
    for i, text in rows:
        r, want = got[i], brute.pii(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == want[:4] and r.b == want[5], (i, r.b, want)
        assert set(filter(None, r.b.split(","))) <= set(r.s.split(","))
    assert collected(pii.extract(empty)) == [] and pii.extract(repeated).count() == 7


def test_pii_contexts_find_more(spark):
    rows = [(i, f"foo {i} telephone: +1 (2{i % 10:02d}) 555-2{i % 10}8{i % 7} bar x") for i in range(40)] + [(100, "my telephone: (988) 555-2485 is here"), (101, "count 123456789 is not")]
    got = {r.doc_id: r for r in pii.extract(frame(spark, rows)).select("*", pii.as_text(F.col("spans")).alias("s"), pii.redact(F.lit(rows[40][1]), F.col("spans")).alias("t")).collect()}
    assert got[100].s == "phone:14:28" and got[100].n_phone == 0 and got[101].s == ""
    assert got[100].t == "my telephone: <phone> is here"


def test_accepted_values_are_marked_without_a_word_before_them(spark):
    rows = [(i, f"foo {i} telephone: +1 (2{i % 10:02d}) 555-2{i % 10}8{i % 7} bar x") for i in range(40)] + [(100, "my telephone: (988) 555-2485 is here")]
    rows += [(101, "(988) 555-2485 at the start"), (102, "after ***** (988) 555-2485"), (103, "(988) 555-0000 is another")]
    got = {r.doc_id: r.s for r in pii.extract(frame(spark, rows)).select("doc_id", pii.as_text(F.col("spans")).alias("s")).collect()}
    assert [got[i] for i in range(100, 104)] == ["phone:14:28", "phone:0:14", "phone:12:26", ""]


def test_patterns_of_words_on_both_sides(spark):
    """Planted: one word before says nothing alone, the words on both sides do; long texts take linear time."""
    import time

    rows = [(i, f"ring me on +44 20 79{i:02d} 09{i % 50:02d} any time") for i in range(30)] + [(100 + i, f"spent on 7{i:02d}00-22{i:02d} goods") for i in range(60)]
    rows += [(300, "so ring me on 020 7946 0123 any day"), (301, "we met on 020 7946 9999 hills")]
    got = {r.doc_id: r.s for r in pii.extract(frame(spark, rows)).select("doc_id", pii.as_text(F.col("spans")).alias("s")).collect()}
    assert got[300] == "phone:14:27" and got[301] == "" and all(got[100 + i] == "" for i in range(60))
    text = ", ".join(f"{i:010d}" for i in range(20_000))
    began = time.time()
    assert len(pii.near_spans(text, pii.base_spans(text))) > 1000 and time.time() - began < 5


def test_exact_duplicates(docs, rows, empty, repeated):
    same(collected(exact_dedup.exact_duplicates(docs)), brute.exact(rows))
    same(collected(exact_dedup.exact_duplicates(docs, first=2, growth=2)), brute.exact(rows))
    assert collected(exact_dedup.exact_duplicates(empty)) == []
    same(collected(exact_dedup.exact_duplicates(repeated)), brute.exact([(r.doc_id, r.text) for r in repeated.collect()]))


def test_bpe(docs, rows, empty, repeated):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=tokenizer_files.pattern(), mergeable_ranks=tokenizer_files.read_ranks(), special_tokens={})
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    for i, text in rows:
        assert got[i].ids == enc.encode_ordinary(text or "") and got[i].decoded == (text or "").encode(), i
    assert collected(bpe.encode(empty)) == [] and bpe.encode(repeated).count() == 7


def test_bpe_fold_in_higher_order_functions(spark):
    ranks = tokenizer_files.read_ranks()
    words = ["", " hello", "Licensed", "é", " naïveté", "zzxq", " 12345", "\n", "🙂"]
    got = bpe.native_word_ids(spark.createDataFrame([(w,) for w in words], "word string"), ranks).collect()
    assert {r.word: r.ids for r in got} == {w: bpe.merged(w.encode(), ranks) if w else [] for w in words}


def test_bpe_merges_of_long_words():
    ranks = tokenizer_files.read_ranks()
    rng = random.Random(3)
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for _ in range(50):
        word = "".join(rng.choice("abtheinr e") for _ in range(rng.randrange(30, 300)))
        assert bpe.merged(word.encode(), ranks) == enc.encode_ordinary(word)


def test_ids_of_many_texts_come_from_words_met_before(rows):
    """Equal to the plain call; a word is encoded once for all texts, and not again by the next task of a process."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    file = open(tokenizer_files.path(tokenizer_files.IDS), encoding="utf-8").read()
    library = Tokenizer.from_str(file)
    texts = [t for _, t in rows[:120]] + ["it's 3.5, don't.\n(x) \"q\"... 'll we'll,\nA1b2 1st, \u00bd e\u0301", "a\nb", "\nlead", "", None, "word, word. word\nWord? word"]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    cache = tokenizer_files.id_cache(file, tokenizer_files.pattern())
    for kind, limit in ((pa.string(), 600_000), (pa.large_string(), 20)):
        cache.store.limit = limit
        for _ in range(2):
            got = [x.tolist() for x in cache.encode_all(pa.array(["cut off", *texts], kind).slice(1))]
            assert got == want
    cache.store.limit, calls, pieces = 600_000, [], cache.store.pieces
    list(cache.encode_all(pa.array(texts)))
    cache.store.pieces = lambda x: calls.append(x) or pieces(x)
    again = tokenizer_files.id_cache(file, tokenizer_files.pattern())
    assert [x.tolist() for x in again.encode_all(pa.array(texts[::-1]))] == want[::-1] and not calls
    list(again.encode_all(pa.array(["a qzqzq known", "known qzqzq", "b qzqzq, word"])))
    assert "".join(calls).split().count("qzqzq") == 1
    cache.store.pieces = pieces


def test_token_files(spark, docs, rows, empty, repeated):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_files.path(tokenizer_files.IDS))
    path = Scratch(spark, "test").path
    token_store.write(docs, path)
    got = {r.doc_id: r for r in token_store.read(spark, path).collect()}
    start = 0
    for i, text in sorted(rows):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids), b"".join(x.to_bytes(4, "little") for x in ids)), i
        start += len(ids)
    for frame_, n in ((empty, 0), (repeated, 7)):
        token_store.write(frame_, path + str(n))
        assert token_store.read(spark, path + str(n)).count() == n


def test_workers_need_no_copy_of_the_package(sf_dir, tmp_path):
    """The package lies where the driver alone looks; workers get what they run by value."""
    import os
    import subprocess
    import sys

    code = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
from rillflow.llm import packing, token_store
docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
token_store.write(docs, "file://" + sys.argv[2])
print("rows", packing.pack(docs).count(), token_store.read(spark, "file://" + sys.argv[2]).count())
"""
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if not (k == "PYTHONPATH" and repo in v)}
    out = subprocess.run([sys.executable, "-c", code, repo, str(tmp_path / "files")], cwd="/", env=env, capture_output=True, text=True, timeout=300)
    rows = next((x for x in out.stdout.splitlines() if x.startswith("rows")), out.stderr[-2000:])
    assert rows.split()[0] == "rows" and int(rows.split()[1]) >= 2 and rows.split()[2] == "2"


def test_blocks():
    import numpy as np

    rng = np.random.default_rng(2)
    for values in ([5], [0], [7] * 100, [0, 2**32 - 1], rng.integers(0, 50_257, 2048), np.where(rng.random(2000) < 0.02, 2**31, rng.integers(100, 130, 2000))):
        x = np.array(values, dtype=np.uint64)
        assert token_store.unpack_block(b"pad" + token_store.pack_block(x), 3).tolist() == x.tolist()
    assert len(token_store.pack_block(np.where(np.arange(2000) % 100 == 0, 2**31, 101).astype(np.uint64))) < 2000 / 8 + 200


def test_quality(spark, sf_dir, empty, repeated):
    import os

    docs = spark.read.parquet(f"{os.path.dirname(sf_dir)}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{os.path.dirname(sf_dir)}/sf0.01/labels.parquet")
    machine = quality.fit(docs, labels)
    got = quality.score(docs, machine).join(labels, "doc_id").select("predicted", "quality", quality.held_out(F.col("doc_id")).alias("out"), "score").collect()
    out = [r for r in got if r.out]
    assert sum(r.predicted == r.quality for r in out) / len(out) >= 0.93
    assert collected(quality.score(empty, machine)) == [] and quality.score(repeated, machine).count() == 7
    def numbers(df):
        return {r.doc_id: r.score for r in quality.score(df, machine).collect()}

    plain, few = docs.limit(50), numbers(docs.limit(50))
    assert few == numbers(plain.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None)).withColumn("label", F.lit(1)).withColumn("chars", F.lit("c")))
    assert few != numbers(plain.withColumn("n_chars", F.lit(1)))
    for unknown in (plain.drop("n_chars"), plain.withColumn("n_chars", F.lit(-5)), plain.withColumn("n_chars", F.lit("many"))):
        assert numbers(unknown) == numbers(plain.withColumn("n_chars", F.lit(None)))
    # Labels of the held-out fold, repeated ones and nulls teach nothing else.
    bent = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("text", F.lit("t"))
    bent = bent.unionByName(labels.withColumn("text", F.lit("u"))).filter("text = 't' or doc_id % 2 = 0").unionByName(labels.limit(3).withColumn("quality", F.lit(None)).withColumn("text", F.lit("v")))
    again = quality.fit(docs, bent)
    assert (again.w == machine.w).all() and (again.v == machine.v).all() and again.bias == machine.bias
    none = quality.fit(empty, labels.limit(0))
    assert {r.score for r in quality.score(repeated, none).collect()} == {0.5}


def test_interactions_in_linear_time():
    import numpy as np

    m = quality.Machine(size=30, rank=4)
    m.w = np.random.default_rng(3).normal(size=30).astype(np.float32)
    index, values = np.array([1, 5, 9, 2]), np.array([0.5, -1, 2, 1], dtype=np.float32)
    raw, _ = m.raw(index, values, np.array([0, 4]))
    pairs = sum(float(m.v[index[a]] @ m.v[index[b]]) * values[a] * values[b] for a in range(4) for b in range(a))
    assert abs(raw[0] - (m.w[index] @ values + pairs)) < 1e-5


def test_repeated_passages(docs, rows, empty, repeated):
    same(collected(substring.repeated_passages(docs)), brute.passages(rows))
    same(collected(substring.repeated_passages(docs, size=6, gram=2, batches=6, fan=2)), brute.passages(rows, 6))
    assert collected(substring.repeated_passages(empty)) == []
    same(collected(substring.repeated_passages(repeated, size=3, gram=2)), brute.passages([(r.doc_id, r.text) for r in repeated.collect()], 3))


def test_repeated_passages_rest_on_words_where_hashes_agree(spark, docs, rows, monkeypatch):
    """Fingerprints of 4 bits: nearly every window is a candidate, and no other word is removed."""
    import numpy as np

    plain = substring.windows
    monkeypatch.setattr(substring, "windows", lambda words, size, seed: plain(words, size, seed) & np.uint64(0xF))
    same(collected(substring.repeated_passages(docs, batches=2)), brute.passages(rows))


def test_passages_of_three_batches(spark, rows, tmp_path):
    """Each batch meets the stored runs; old rows lose what a new batch repeats."""
    path, done = f"file://{tmp_path}/index", []
    some = [(i, t) for i, t in rows if len(t or "") < 3000]
    batches = [some[k::3] for k in range(3)] + [[(None, some[-1][1]), (1, some[-2][1])], []]
    for k, batch in enumerate(batches):
        index = substring.FingerprintIndex(spark, path, size=12, gram=4, fan=2)  # opened anew from its folder
        index.add(frame(spark, batch))
        done += batch
        if k != 0:
            same(collected(index.passages()), brute.passages(done, 12))
    assert len(index.state["runs"]) <= 2 and len(index.state["batches"]) == 5


def test_queries_have_the_columns_of_their_contracts(spark, sf_dir):
    found = queries.queries()
    assert [n.split("_")[0] for n in found][:10] == [f"op{k}" for k in range(1, 11)] and "pipeline" in found
    assert set(queries.oracle_sql()) <= set(found)


def thue_morse(a, b, n=2048):
    """Two words on which every polynomial hash modulo 2**64 agrees."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join((a, b)[x] for x in bits), "".join((b, a)[x] for x in bits)


def test_words_that_collide_in_polynomial_hashes_stay_apart(spark):
    one, two = thue_morse("a", "b")
    five = [(1, f"p q {one} r s"), (2, f"p q {two} r s"), (3, f"p q {one.upper()} r s")]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, five)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    around = " ".join(f"w{k}" for k in range(20))
    rows = [(1, f"{around} {one} {around}"), (2, f"{around} {two} {around}")]
    same(collected(substring.repeated_passages(frame(spark, rows))), brute.passages(rows))
    assert all(r.n_removed == 0 for r in substring.repeated_passages(frame(spark, rows)).collect())


def test_links_rest_on_words_where_hashes_agree(spark, monkeypatch):
    """Shingle hashes of 6 bits: many pairs look alike, and none without a link is linked."""
    import numpy as np

    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(30))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " tail") for i in range(5)]
    plain = near_dup.windows
    monkeypatch.setattr(near_dup, "windows", lambda words, size, seed: plain(words, size, seed) & np.uint64(0x3F))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    want = {i: c for i, (_, c) in brute.near(rows).items()}
    assert all(got[i] == want[i] for i in range(40))


def test_near_copies_in_many_blocks(spark):
    """One group of near copies, some linked to few others, over more blocks than one."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice((1, 2))):
            words[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(f"c{k}x{i}" for k in range(40))) for i in range(10)]
    for block, pivots in ((8, 2), (8, 0)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(frame(spark, rows), block=block, pivots=pivots).collect()}
        assert got == brute.near(rows)
