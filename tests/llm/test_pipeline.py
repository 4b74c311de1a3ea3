"""The stages, one by one, against plain versions of their decisions."""

import os

from pyspark.sql import functions as F

import corpus_pipeline
from rillflow.llm import quality
from rillflow.llm.work import shared_folder

from . import brute


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, machine).filter("predicted = 1").collect()}
    rows = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := str(tmp_path / name))
        docs = spark.read.parquet(path)
        if name == "exact_dedup":
            rows = {i: rows[i] for i, low, _, kept, _ in brute.exact(list(rows.items())) if kept}
        elif name == "near_dedup":
            rows = {i: rows[i] for i, (_, c) in brute.near(list(rows.items()), 80).items() if i == c}
        elif name == "pii":
            for i in rows:
                text = rows[i] or ""
                for kind, a, b in reversed([s.split(":") for s in brute.pii(text)[5].split(",") if s]):
                    text = text[: int(a)] + f"<{kind}>" + text[int(b) :]
                rows[i] = text
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
            assert {r.doc_id: r.text for r in docs.collect()} == rows, name
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert {r.doc_id for r in pieces} == set(rows) and all(r.n == r["all"] for r in pieces)


def test_run_on_an_empty_table(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_results_stay_in_the_shared_folder(spark, sf_dir):
    folder = lambda: set(os.listdir(shared_folder(spark).removeprefix("file://")))
    before = folder()
    out = corpus_pipeline.run(spark, sf_dir)
    (new,) = folder() - before
    assert new.startswith("pipeline-") and os.listdir(f"{shared_folder(spark).removeprefix('file://')}/{new}") == ["packing"]
    assert out.count() > 0
    before = folder()
    stage = corpus_pipeline.exact_dedup_stage(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    (new,) = folder() - before
    assert new.startswith("exact-dedup-stage-") and stage.count() > 0


def test_near_dedup_takes_a_similarity_of_80_percent(spark):
    words = [f"w{i}" for i in range(104)]
    texts = [" ".join(words), " ".join([*words[:93], *(f"v{i}" for i in range(11))]), " ".join(f"u{i}" for i in range(50))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, (_, c) in brute.near(list(enumerate(texts)), 80).items() if i == c}
    assert want == {0, 2} and len({c for _, c in brute.near(list(enumerate(texts))).values()}) == 3
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == want


def test_rows_that_share_an_id_or_have_none(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).repartition(3)
    got = lambda stage, rows: sorted(((r.doc_id, r.text) for r in stage(spark, frame(rows), "").collect()), key=str)
    rows = [(None, "mail a.b@c.example now"), (None, "nothing to hide in here"), (None, None), (7, "x 10.1.2.3"), (7, "call +44 20 7946 0958 today"), (7, "clean")]
    want = [(None, "mail <email> now"), (None, "nothing to hide in here"), (None, None), (7, "x <ip>"), (7, "call <phone> today"), (7, "clean")]
    assert got(corpus_pipeline.pii_stage, rows) == sorted(want, key=str)
    rows = [(9, words(1)), (3, words(1)), (3, words(1)), (None, words(2)), (None, words(2)), (None, words(1)), (3, words(3)), (5, words(2))]
    want = sorted([(3, words(1)), (5, words(2)), (3, words(3))], key=str)
    assert got(corpus_pipeline.exact_dedup_stage, rows) == want
    assert got(corpus_pipeline.near_dedup_stage, rows) == want


def test_quality_decides_by_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = quality.score(docs, machine).filter("predicted = 1").count()
    assert 0 < good < docs.count()
    # The model is fitted on labelled ids, so it stays as it is while only the ids it is not fitted on are null.
    labelled = [r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    nulls = docs.withColumn("doc_id", F.when(F.col("doc_id").isin(labelled), F.col("doc_id")))
    assert nulls.filter("doc_id is null").count() > 1
    assert corpus_pipeline.quality_stage(spark, nulls, sf_dir).count() == good


def test_every_stage_takes_odd_rows_and_clashing_columns(spark, sf_dir):
    """Nulls in all columns, empty and very long texts, ties, and columns named like those that stages make."""
    base = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS).limit(30)
    long = " ".join(f"w{i % 977}x{i}" for i in range(40_000)) + " mail a.b@c.example"
    odd = [(None, None, None, None, None), (5000, "", None, "s", 0), (5001, long, "en", None, len(long)), (5001, long, "en", "s", len(long)), (5002, "call +44 20 7946 0958", "en", "s", 21), (5002, None, "en", "s", None)]
    docs = base.unionByName(spark.createDataFrame(odd, base.schema))
    clashes = ("kept_id", "id", "spans", "row", "tie", "start", "n", "component", "kept", "doc", "label", "score")
    docs = docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(clashes)))
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, sf_dir).collect()
        assert got, name
        if name != "packing":
            assert got[0].__fields__ == corpus_pipeline.COLUMNS
        if name == "exact_dedup":
            assert sum(r.doc_id == 5001 for r in got) == 1 and sum(r.text is None or r.text == "" for r in got) == 1
        if name == "near_dedup":
            assert sum(r.doc_id == 5001 for r in got) == 1
        if name == "pii":
            assert sorted(r.text or "" for r in got if r.doc_id == 5002) == ["", "call <phone>"]
            assert all(r.text.endswith("mail <email>") for r in got if r.doc_id == 5001)
        if name == "packing":
            assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
