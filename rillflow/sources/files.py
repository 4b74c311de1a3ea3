"""csv(), json(), ndjson() and parquet() as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..plans import typed as ty
from ..plans.frame import Frame, from_spark, ref
from ..plans.typed import Typed


def _guess(df: DataFrame) -> dict[str, str]:
    """Types of text columns that all of their rows fit: datetime, bool, long, real, else string.  One pass over the files."""
    tests: dict[str, Callable[[Column], Column]] = {
        "datetime": lambda c: F.try_to_timestamp(c).isNotNull() & c.rlike(r"^\d{4}-\d\d?-\d\d?"),
        "bool": lambda c: F.lower(c).isin("true", "false"),
        "long": lambda c: c.try_cast("bigint").isNotNull() & ~c.contains("."),
        "real": lambda c: c.try_cast("double").isNotNull(),
    }
    full = lambda n: (ref(n).isNotNull()) & (ref(n) != "")
    aggs = [F.coalesce(F.every(F.when(full(n), f(ref(n)))), F.lit(False)).alias(f"{i}.{k}") for i, n in enumerate(df.columns) for k, f in tests.items()]
    got = df.agg(*aggs).first()
    return {n: next((k for k in tests if got[f"{i}.{k}"]), "string") for i, n in enumerate(df.columns)}


def typed_texts(df: DataFrame, types: dict[str, str]) -> Frame:
    """Text columns as the given types; an empty text is null, but for strings."""
    cols = {n: ty.cast(Typed(ref(n) if types[n] == "string" else F.nullif(ref(n), F.lit("")), "string"), types[n]) for n in df.columns}
    return Frame(df.select(*[x.col.alias(n) for n, x in cols.items()]), {n: x.type for n, x in cols.items()})


def csv(spark: SparkSession, path: str) -> Frame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\0").option("emptyValue", "").csv(path)
    return typed_texts(df, _guess(df))


def json(spark: SparkSession, path: str) -> Frame:
    return from_spark(spark.read.option("multiLine", True).json(path))


def ndjson(spark: SparkSession, path: str) -> Frame:
    return from_spark(spark.read.json(path))


def flat(df: DataFrame) -> DataFrame:
    """Structs as dotted leaves."""

    def leaves(kind: S.StructType, at: Column | None, name: str):
        for f in kind.fields:
            col = ref(f.name) if at is None else at[f.name]
            full = f"{name}.{f.name}" if name else f.name
            if isinstance(f.dataType, S.StructType):
                yield from leaves(f.dataType, col, full)
            else:
                yield col.alias(full)

    return df.select(*leaves(df.schema, None, ""))


def parquet(spark: SparkSession, path: str) -> Frame:
    return from_spark(flat(spark.read.parquet(path)))


FILES: dict[str, Callable[[SparkSession, str], Frame]] = {"csv": csv, "json": json, "ndjson": ndjson, "parquet": parquet}
