"""Cutting the lineage of iterative plans with Parquet tables in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session's spark.checkpoint.dir. Where that is unset, a session whose executors are threads
    of this process gets one below the warehouse; any other session must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return root.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new place below the shared folder, for as long as this process runs."""
    path = f"{shared_root(spark)}/hostloom-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def cut(df: DataFrame) -> DataFrame:
    """df, written below the shared folder and read again."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hostloom_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes tables that cut() made; only when no lazy frame reads them any more."""
    for df in frames:
        _delete(df.sparkSession, df._hostloom_path)
        _made.remove((df.sparkSession, df._hostloom_path))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            try:
                _delete(spark, path)
            except Exception:  # noqa: BLE001  the JVM may be gone at exit; the folder is scratch
                return
