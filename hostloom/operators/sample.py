"""Samples: rows of the smallest hashes, in exact number, and whole blocks of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs  # noqa: F401  as pa.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .lineage import cut

#: Bits of a row's hash, and those that one histogram tells apart (32 768 bins at most).
BITS, STEP = 60, 15


def place(columns: list[str], seed: int) -> Column:
    """The row's place: 60 bits of a digest of the seed and the columns' text; null counts as a text of its own."""
    parts = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, BITS // 4), 16, 10).cast("long")


def smallest(df: DataFrame, n: int, seed: int = 42, by: list[str] | None = None, total: int | None = None) -> DataFrame:
    """The n rows of the smallest places (all, if there are fewer): a uniform sample of exact size, whatever the rows' order.

    by: the columns that tell rows apart (null: all that have a text). Rows that are equal in them have one place; if the bound falls on
    it, any of them are taken. The bound is found by histograms of the places' leading bits, each of the one bin in which the last left off, so no
    rows are ordered and none pass through one task.
    """
    by = by or [f.name for f in df.schema if f.dataType.typeName() not in ("map", "variant")]
    at = place(by, seed)
    prefix, shift, left = 0, BITS, n
    while shift and left:
        shift -= STEP
        rows = df.select(at.alias("at")).filter(F.shiftright("at", shift + STEP) == prefix)
        bins = {r[0]: r[1] for r in rows.groupBy(F.shiftright("at", shift).alias("bin")).count().collect()}
        if shift == BITS - STEP and sum(bins.values()) <= n:
            return df
        for prefix in sorted(bins):
            if bins[prefix] > left:
                break
            left -= bins[prefix]
            if not left:
                prefix += 1  # noqa: PLW2901  the bound lies behind this bin
                break
    sampled = df.filter(at < (prefix << shift))
    return sampled.unionByName(some(df.filter(at == prefix), left)) if left else sampled


def some(rows: DataFrame, n: int) -> DataFrame:
    """Any n of the rows: a quota for each partition, so that they don't meet in one."""
    rows = cut(rows)
    part, k = F.shiftright("\0k", 33), F.col("\0k").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("\0k", F.monotonically_increasing_id())
    quota, left = [], n
    for r in rows.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a partition
        quota.append((r[0], min(r[1], left)))
        left -= quota[-1][1]
    quotas = F.broadcast(rows.sparkSession.createDataFrame(quota, "`\0part` long, `\0quota` long"))
    return rows.join(quotas, part == F.col("\0part")).filter(k < F.col("\0quota")).drop("\0k", "\0part", "\0quota")


def sampled(df: DataFrame, percent: float, most: int, seed: int = 42, by: list[str] | None = None) -> DataFrame | None:
    """min(percent of the rows, most) rows, rounded down; None of an empty table or where that is no row, so that a ladder of scans goes on."""
    n = min(int(df.count() * percent / 100), most)
    return smallest(df, n, seed, by) if n else None


# Blocks


def _opened(path: str):
    uri = "file://" + path.removeprefix("file:").removeprefix("//") if path.startswith(("/", "file:")) else path
    system, at = pa.fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(system.open_input_file(at))


def files(spark: SparkSession, path: str) -> list[str]:
    """The data files at path, a file, a folder or a pattern."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for f in hadoop.getFileSystem(conf).globStatus(hadoop) or []:
        inner = f.getPath().getFileSystem(conf).listStatus(f.getPath()) if f.isDirectory() else [f]
        found += [g.getPath().toString() for g in inner if g.isFile() and not g.getPath().getName().startswith(("_", "."))]
    return sorted(found)


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, row_group, n_rows of Parquet files, from their footers, which are read in one job. The storage is one that Arrow opens."""
    paths = files(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with _opened(name) as f:
                    n = [f.metadata.row_group(k).num_rows for k in range(f.num_row_groups)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(n)), pa.array(range(len(n)), pa.int32()), pa.array(n, pa.int64())], names=["path", "row_group", "n_rows"])

    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 10_000)))
    return listed.mapInArrow(run, "path string, row_group int, n_rows long")


def block_sample(spark: SparkSession, path: str, percent: float, seed: int = 42) -> DataFrame:
    """About percent of a table's blocks (the row groups of its files), each whole; only these are read. A block is taken by a hash of the
    file's name, its number and the seed, so the same ones are taken again."""
    schema = spark.read.parquet(path).schema
    arrow = to_arrow_schema(schema)
    place = F.pmod(F.xxhash64(F.substring_index("path", "/", -1), "row_group", F.lit(seed)), F.lit(1_000_000))
    chosen = cut(blocks(spark, path).filter(place < int(percent * 10_000)).select("path", "row_group"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _opened(name) as f:
                    yield from f.read_row_group(k, columns=arrow.names).select(arrow.names).cast(arrow).to_batches(10_000)

    return chosen.repartition(max(1, min(chosen.count(), 10_000))).mapInArrow(run, schema)
