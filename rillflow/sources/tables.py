"""Stored tables: a folder of Parquet files and a schema beside it, under one root."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..lang.lexer import QueryError
from ..plans.frame import Frame
from ..plans.typed import SPARK, cast

RECEIVED = "_TimeReceived"
_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; where Spark runs on this machine alone and it is unset, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="rillflow-"))
            atexit.register(shutil.rmtree, _local[0], True)
        base = "file://" + _local[0]
    return f"{base.rstrip('/')}/step-{uuid.uuid4().hex}"


def scratch(df: DataFrame) -> DataFrame:
    """Writes a frame to a folder of its own and reads it again, which cuts its lineage."""
    spark, path = df.sparkSession, folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spark_schema(types: dict[str, str]) -> S.StructType:
    return S.StructType([S.StructField(n, S._parse_datatype_string(SPARK[k])) for n, k in types.items()])


class Catalog:
    """Tables under a root.  Each has ``schema.json`` and ``data/``; views and functions are JSON beside them.

    The schema files are written by the driver through Spark's file system, so the
    root may be in any store that Spark can write.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # -- small files
    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        return self._fs(name).exists(self._path(name))

    def load(self, name: str):
        if not self.exists(name):
            return None
        stream = self._fs(name).open(self._path(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def save(self, name: str, value) -> None:
        stream = self._fs(name).create(self._path(name), True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()

    def move(self, a: str, b: str) -> None:
        self._fs(b).mkdirs(self._path(b).getParent())
        self._fs(a).rename(self._path(a), self._path(b))

    def delete(self, name: str) -> None:
        self._fs(name).delete(self._path(name), True)

    def folders(self) -> list[str]:
        if not self.exists(""):
            return []
        return sorted(s.getPath().getName() for s in self._fs("").listStatus(self._path("")) if s.isDirectory())

    # -- tables
    def tables(self) -> list[str]:
        return [n for n in self.folders() if not n.startswith((".", "_")) and self.exists(f"{n}/schema.json")]

    def schema(self, name: str) -> dict[str, str] | None:
        return self.load(f"{name}/schema.json")

    def create(self, name: str, types: dict[str, str], received: bool = True) -> None:
        if self.exists(f"{name}/schema.json"):
            raise QueryError(f"table {name} exists")
        self.save(f"{name}/schema.json", types | ({RECEIVED: "datetime"} if received and RECEIVED not in types else {}))

    def merge(self, name: str, types: dict[str, str]) -> None:
        old = self.schema(name)
        if old is None:
            return self.create(name, types)
        for n, k in types.items():
            if old.get(n, k) != k:
                raise QueryError(f"column {n} is {old[n]}, not {k}")
        received = {RECEIVED: old.pop(RECEIVED)} if RECEIVED in old else {}
        self.save(f"{name}/schema.json", old | types | received)

    def read(self, name: str) -> Frame | None:
        types = self.schema(name)
        if types is None:
            return None
        data = f"{self.root}/{name}/data"
        if not self.exists(f"{name}/data"):
            return Frame(self.spark.createDataFrame([], spark_schema(types)), types)
        return Frame(self.spark.read.schema(spark_schema(types)).parquet(data), types)

    def append(self, name: str, frame: Frame) -> DataFrame:
        """Adds rows by column name; what is missing is null, the time of receipt is now."""
        types = self.schema(name)
        if types is None:
            raise QueryError(f"unknown table {name}")
        names = frame.names
        cols = [cast(names[n], k).col.alias(n) if n in names else (F.current_timestamp() if n == RECEIVED else F.lit(None).cast(SPARK[k])).alias(n) for n, k in types.items()]
        rows = frame.df.select(*cols)
        rows.write.mode("append").parquet(f"{self.root}/{name}/data")
        return rows

    def replace(self, name: str, df: DataFrame) -> None:
        """Rewrites a table beside itself and swaps the folders; the old one is kept for ``.gc``."""
        new = f"{name}/.new-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{new}")
        if self.exists(f"{name}/data"):
            self.move(f"{name}/data", f"{name}/.superseded/{time.time_ns()}")
        self.move(new, f"{name}/data")

    def drop(self, name: str) -> None:
        if self.schema(name) is None:
            raise QueryError(f"unknown table {name}")
        self.move(name, f".dropped/{name}-{time.time_ns()}")

    def extents(self, name: str) -> list[tuple[str, int]]:
        if not self.exists(f"{name}/data"):
            return []
        return sorted((s.getPath().getName(), s.getLen()) for s in self._fs(name).listStatus(self._path(f"{name}/data")) if s.getPath().getName().endswith(".parquet"))


