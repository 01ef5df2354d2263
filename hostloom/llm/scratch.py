"""Cutting lineage with Parquet tables in the shared folder that the cluster names, and the memory of Python workers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir. Where that is unset, a session whose executors are threads
    of this process has one below the warehouse; any other session must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            try:
                drop(spark, path)
            except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is scratch
                return


def narrow_batches(spark: SparkSession, rows: int = 512) -> None:
    """Texts are wide rows: Arrow batches get fewer of them, unless the session has a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, rows)


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where its libraries can do that."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable) -> Callable:
    """run, a function of Arrow batches. Workers serve task after task and stage after stage, so each gives back at its end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return wrapped


class Scratch:
    """A folder for one operator call. Tables in it survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.path = f"{shared_root(spark)}/hostloom-{uuid.uuid4().hex}"
        self.n = 0
        _made.append((spark, self.path))

    def cut(self, df: DataFrame) -> DataFrame:
        """df, written as Parquet and read again."""
        path = f"{self.path}/{self.n}"
        self.n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._hostloom_path = path
        return out

    def forget(self, df: DataFrame) -> None:
        """Deletes a table that cut() made; only when no lazy frame reads it any more."""
        drop(self.spark, df._hostloom_path)
