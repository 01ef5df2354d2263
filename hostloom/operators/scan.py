"""Scans of tables: sampling, conversion of complex types, text projections, reports and file loading."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import host as H
from .sample import sampled

log = logging.getLogger(__name__)


def hostname_samples(df: DataFrame, columns: list[str], percent: float = 1, most: int = 100, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """hostname: the values that look like host names in the first three columns of a sample of rows, most at most, whose
    first column isn't null. The sample goes by hashes, so it is of all rows whatever their order."""
    rows = sampled(df.filter(F.col(columns[0]).isNotNull()), percent, most, seed, by)
    rows = df.limit(0) if rows is None else rows
    values = rows.select(F.explode(F.array(*(F.col(c).cast("string") for c in columns[:3]))).alias("hostname"))
    return values.filter(H.looks_like_hostname(F.col("hostname")))


def training_export(rows: DataFrame, catalog: DataFrame, hostname: str = "host_name") -> DataFrame:
    """Rows kind, value: distinct host names that look like ones, tables and columns."""
    names = rows.filter(H.looks_like_hostname(F.col(hostname))).select(F.lit("hostname").alias("kind"), F.col(hostname).alias("value")).distinct()
    return names.union(catalog.select(F.lit("table"), "table_name").distinct()).union(catalog.select(F.lit("column"), "column_name").distinct())


def scan_statistics(export: DataFrame, catalog: DataFrame, seconds: float | None = None) -> DataFrame:
    """One row: tables, columns and host names; with the seconds that a scan took, tables a second too."""
    found = export.agg(F.count_if(F.col("kind") == "table").alias("n_tables"), F.count_if(F.col("kind") == "hostname").alias("n_hostnames"))
    out = found.crossJoin(catalog.agg(F.count("*").alias("n_columns")))
    return out.withColumn("tables_per_second", F.col("n_tables") / F.lit(seconds)) if seconds else out


def is_complex(kind: T.DataType) -> bool:
    return isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def complex_as_json(df: DataFrame) -> DataFrame:
    return df.select(*(F.to_json(f.name).alias(f.name) if is_complex(f.dataType) else F.col(f.name) for f in df.schema))


def nan_as_null(df: DataFrame) -> DataFrame:
    return df.select(*(F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema))


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text: times in ISO form, complex values as JSON."""

    def text(f: T.StructField):
        if is_complex(f.dataType):
            return F.to_json(f.name)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(f.name, "yyyy-MM-dd'T'HH:mm:ss")
        return F.col(f.name).cast("string")

    return df.select(*(text(f).alias(f.name) for f in df.schema))


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as numbers; what is none is 0."""
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) for c in columns})


def report(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """A row a table from schemas alone; a table that couldn't be read is failed."""
    rows = [(name, "failed" if df is None else "metadata_only", 0 if df is None else len(df.schema)) for name, df in tables.items()]
    return spark.createDataFrame(rows, "table_name string, scan_type string, n_columns long")


def load(spark: SparkSession, paths: list[str], skip_corrupt: bool = False) -> DataFrame:
    """Parquet files as one table; with skip_corrupt, files that can't be read are logged and left out. All footers are read in
    one job, whose result is the schema of the files that can be read; the scan passes over the others."""
    if not skip_corrupt:
        return spark.read.parquet(*paths)
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    there = []
    for path in paths:
        p = hadoop.Path(path)
        if p.getFileSystem(conf).exists(p):
            there.append(path)
        else:
            log.warning("%s isn't there", path)
    try:
        if not there:
            raise ValueError("none of the files is there")
        return spark.read.options(ignoreCorruptFiles=True, mergeSchema=True).parquet(*there)
    except AnalysisException as e:
        raise ValueError("none of the files can be read") from e


class LoadCache:
    """Frames by key, kept by the cluster; over most bytes, the oldest one goes. Sizes are the optimiser's estimates."""

    def __init__(self, most: int = 8 << 30):
        self.most, self.held = most, {}

    def get(self, key: str, load: Callable[[], DataFrame]) -> DataFrame:
        if key not in self.held:
            df = load()
            size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
            if self.held and size + sum(s for _, s in self.held.values()) > self.most:
                self.drop(next(iter(self.held)))
            self.held[key] = df.persist(StorageLevel.MEMORY_AND_DISK), size
        return self.held[key][0]

    def drop(self, key: str) -> None:
        self.held.pop(key)[0].unpersist()


def scan(strategies: list) -> tuple[DataFrame | None, str]:
    """The result of the first strategy that succeeds with a frame, and its name; each is a function of no argument."""
    for strategy in strategies:
        try:
            found = strategy()
        except Exception as e:  # noqa: BLE001  the ladder goes on to the next way of reading
            log.warning("%s failed: %s", strategy.__name__, e)
            continue
        if found is not None:
            return found, strategy.__name__
    return None, "failed"
