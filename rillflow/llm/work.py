"""Tables between two steps, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Scratches that belong to the ``settled`` that is running.
_made: contextvars.ContextVar[list[Scratch] | None] = contextvars.ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and Spark runs on this machine alone, a temporary folder.

    A cluster without that setting is an error: a folder of one machine would lose rows.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="rillflow-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings that hold within the block; names with __ for dots."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Scratch:
    """Parquet tables of one run of an operator.

    ``put`` writes a frame and reads it again: that cuts the lineage, so a lost
    executor costs no more than the step that was running.  The step's shuffle
    files go when it ends.  Tables that no result reads any more go with ``drop``.
    ``batch_rows``: rows that one Arrow batch sends to Python meanwhile.
    """

    def __init__(self, spark: SparkSession, name: str, batch_rows: int | None = None, path: str | None = None):
        self.spark, self.batch_rows = spark, batch_rows
        self.path = path.rstrip("/") if path else f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if not path and (made := _made.get()) is not None:
            made.append(self)

    def put(self, frame: DataFrame, table: str) -> DataFrame:
        path = f"{self.path}/{table}"
        held = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"}
        if self.batch_rows:
            held["spark__sql__execution__arrow__maxRecordsPerBatch"] = str(self.batch_rows)
        with settings(self.spark, **held):
            frame.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        for table in tables:
            self._delete(f"{self.path}/{table}")

    def drop_all(self) -> None:
        self._delete(self.path)

    def _delete(self, place: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def release(self) -> None:
        """Lets Spark delete the shuffle files of frames that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def settled(out: Scratch, table: str, frame: Callable[[], DataFrame]) -> DataFrame:
    """What ``frame`` gives, put into ``out``; every scratch that was made on the way is deleted."""
    made: list[Scratch] = []
    token = _made.set(made)
    try:
        return out.put(frame(), table)
    finally:
        _made.reset(token)
        for scratch in made:
            scratch.drop_all()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file in any file system that Spark can reach; None if there is none."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the place, then renames, so a reader finds the old file or the new one."""
    jvm = spark.sparkContext._jvm
    new, place = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(place):
        fs.delete(place, False)
    fs.rename(new, place)


def is_empty(frame: DataFrame) -> bool:
    return not frame.take(1)
