"""Exact duplicates by distributed most-significant-digit radix partitioning.

A digit is the next run of bytes of a normalised text: 64 bytes at first, eight
times as many at each level.  Level by level, a group splits by its next digit;
the groups' sizes come from a partial aggregation, so a text that a third of the
rows share is counted before the shuffle, and the rows join their group by a
sort-merge join, in which Spark splits large partitions.  A group of one row, or
one whose texts have ended, is finished.  Equality rests on the bytes alone; the
SHA-256 is output, no key.

Native: DataFrame functions only, no Python on the executors.

Defined cases: null text counts as empty; of equal texts the smallest doc_id
stays, a null doc_id only if the group has no other; rows that repeat a doc_id
and a text are all kept or all dropped, as the id decides.  Other columns are
ignored, an empty table gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Scratch, is_empty

FIRST, GROWTH = 64, 8
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """UTF-8 bytes of a text after replacing each run of white space by one space."""
    return F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), "UTF-8")


def exact_duplicates(docs: DataFrame, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for every row of docs (doc_id, text, ...)."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    own = F.col("doc_id").cast("long").alias("doc_id")
    left = docs.select(own, normalised(F.col("text")).alias("rest"))
    left = left.select("doc_id", F.lit(0).cast("long").alias("group"), F.unhex(F.sha2("rest", 256)).alias("sha"), "rest")
    done, width, level = [], first, 0
    while True:
        digit = F.substring("rest", 1, width)
        rest = F.expr(f"substring(rest, {width + 1})")
        groups = left.groupBy("group", digit.alias("digit")).agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
        # Groups of one row are left out: a row without a partner here is alone.  A written number names each other group.
        groups = scratch.put(groups.filter("n > 1").withColumn("next", F.monotonically_increasing_id()), f"groups-{level}")
        split = left.select("doc_id", "group", "sha", digit.alias("digit"), rest.alias("rest")).join(groups.hint("merge"), ["group", "digit"], "left")
        open_ = F.col("n").isNotNull() & (F.octet_length("digit") == width)
        step = split.select("doc_id", "sha", F.coalesce("n", F.lit(1)).alias("n"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("low"), open_.alias("open"), F.when(open_, F.col("next")).alias("group"), F.when(open_, F.col("rest")).alias("rest"))
        step = scratch.put(step, f"level-{level}")
        done.append(step.filter("not open").select("doc_id", F.col("low").alias("keep_id"), F.col("n").alias("group_size"), "sha"))
        left = step.filter("open").select("doc_id", "group", "sha", "rest")
        if is_empty(left):
            break
        width, level = width * growth, level + 1
    out = reduce(DataFrame.unionByName, done)
    return out.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
