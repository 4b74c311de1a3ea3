"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.

quality          rows that the classifier rejects go
exact_dedup      of equal texts the one with the smallest doc_id stays
near_dedup       of each group of texts at a similarity of 0.8 or more one stays
pii              personal data in the texts is replaced by <kind>
packing          pieces of sequences of 2048 tokens

A stage's result is written before the stage returns; all that it wrote on the
way is deleted then.

Defined cases: null text is quality's empty text and stays null, if it stays;
ids may repeat or be null: every row goes, stays and is redacted by its own text,
and of equal rows with one id, or with none, one stays; columns beyond those of
documents are dropped; an empty table gives no sequence.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm import exact_dedup, near_dup, packing, pii, quality
from rillflow.llm.work import Scratch, settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(spark: SparkSession, docs: DataFrame, by_id: bool = False) -> DataFrame:
    """docs with a written unique number for each row; by_id: it rises with doc_id, null ids come last."""
    rows = docs.select(*COLUMNS)
    if by_id:
        rows = rows.withColumn("tie", F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), "tie").drop("tie")
    return Scratch(spark, "numbered").put(rows.withColumn("row", F.monotonically_increasing_id()), "rows")


def _texts(rows: DataFrame) -> DataFrame:
    """What an operator takes, with the row's number as its id."""
    return rows.select(F.col("row").alias("doc_id"), "text", "n_chars")


def _only(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows whose number is a doc_id of kept."""
    kept = kept.select(F.col("doc_id").alias("row"))
    return rows.join(kept.hint("merge"), "row", "left_semi").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    machine = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))

    def good() -> DataFrame:
        rows = _numbered(spark, docs)
        return _only(rows, quality.score(_texts(rows), machine).filter("predicted = 1"))

    return settled(Scratch(spark, "quality-stage"), "rows", good)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def unequal() -> DataFrame:
        rows = _numbered(spark, docs, by_id=True)
        return _only(rows, exact_dedup.exact_duplicates(_texts(rows)).filter("kept"))

    return settled(Scratch(spark, "exact-dedup-stage"), "rows", unequal)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def unlike() -> DataFrame:
        rows = _numbered(spark, docs, by_id=True)
        return _only(rows, near_dup.near_duplicates(_texts(rows), percent=80).filter("kept"))

    return settled(Scratch(spark, "near-dedup-stage"), "rows", unlike)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    def redacted() -> DataFrame:
        rows = _numbered(spark, docs)
        spans = pii.extract(_texts(rows)).filter(F.size("spans") > 0).select(F.col("doc_id").alias("row"), "spans")
        out = rows.join(spans.hint("merge"), "row", "left")
        text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(pii.redact(F.col("text"), F.col("spans")))
        return out.select("doc_id", text.alias("text"), "lang", "source", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast("long").alias("n_chars"))

    return settled(Scratch(spark, "pii-stage"), "rows", redacted)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_dedup_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: The classifier is learned, which SQL cannot express; a test holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written, read again by the next, and deleted when that stands."""
    scratch, before = Scratch(spark, "pipeline"), None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(scratch, name, partial(stage, spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name
    return docs
