"""Token counts by separator scan over flat, unindexed token files.

A token file is nothing but token ids, 16 or 32 bits each, every document ended by an end-of-document
id. Files are read in blocks of a fixed number of tokens that know nothing of documents. Each block
is searched for the separator in one vectorised step, which gives the documents that lie whole in it
and its head and tail; a prefix scan over the blocks' summaries, in two levels, then tells where the
document begins that a block's first separator ends, and which ordinal it has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs  # noqa: F401  as pa.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, uncollected, vocabulary_path
from .scratch import Scratch, narrow_batches
from .shingles import chunks, text_buffers

#: Tokens of a block, and blocks of a run of the prefix scan's lower level.
BLOCK, RUN = 1 << 16, 1 << 12
VOCABULARY, END_OF_DOCUMENT = "word_bpe_49k.json", 49407
SUMMARY = "file string, block long, n_tokens long, n_ends long, head long, tail long, inner array<long>"


def _scan(separator: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for payload in batch.column(2):
                tokens = np.frombuffer(payload.as_buffer() or b"", np.dtype(f"<u{bits // 8}"))
                ends = np.flatnonzero(tokens == separator)
                last = ends[-1] + 1 if len(ends) else 0
                rows.append((len(tokens), len(ends), int(ends[0]) if len(ends) else len(tokens), int(len(tokens) - last), np.diff(ends) - 1))
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, pa.array([r[4] for r in rows], pa.list_(pa.int64()))], names=["file", "block", "n_tokens", "n_ends", "head", "tail", "inner"])

    return run


def token_counts(blocks: DataFrame, separator: int = END_OF_DOCUMENT, bits: int = 16) -> DataFrame:
    """Rows file, ordinal, n_tokens, ended: the documents of token files, counted from 0 in each file.

    blocks: file string, block long from 0 on without gaps, payload binary (token ids, little-endian). The
    separator isn't counted. Tokens after a file's last separator are a document with ended = false; a file
    without tokens has no document, two separators in a row enclose a document of 0 tokens. An empty
    table gives an empty result. Other columns are not read; a null payload is an empty block.
    """
    scanned = blocks.select(F.col("file").cast("string").alias("file"), F.col("block").cast("long").alias("block"), "payload").mapInArrow(_scan(separator, bits), SUMMARY)
    scanned = Scratch(blocks.sparkSession).cut(scanned.withColumn("run", F.floor(F.col("block") / RUN)))
    # Upper level: each run's totals, and what lies open at its start
    open_ = F.max(F.when(F.col("n_ends") > 0, F.struct("block", "tail")))
    runs = scanned.groupBy("file", "run").agg(F.sum("n_ends").alias("ends"), F.sum("n_tokens").alias("all"), open_.alias("open"))
    after = scanned.join(runs.select("file", "run", F.coalesce("open.block", F.lit(-1)).alias("at")), ["file", "run"]).filter("block > at").groupBy("file", "run").agg(F.sum("n_tokens").alias("more"))
    runs = runs.join(after, ["file", "run"], "left").select("file", "run", "ends", "all", (F.coalesce("open.tail", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("left"))
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = _carried(runs, before, "run", F.col("ends"), F.col("all"), F.col("left")).select("file", "run", F.col("ordinal").alias("run_ordinal"), F.col("carried").alias("run_carried"), F.col("seen").alias("run_seen"))
    # Lower level: the same within each run
    before = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = _carried(scanned, before, "block", F.col("n_ends"), F.col("n_tokens"), F.col("tail")).join(runs, ["file", "run"])
    first = F.col("carried") + F.when(F.col("seen"), 0).otherwise(F.col("run_carried"))
    own = own.withColumns({"ordinal": F.col("ordinal") + F.col("run_ordinal"), "first": first + F.col("head")})
    whole = own.filter("n_ends > 0").select("file", F.posexplode(F.concat(F.array("first"), "inner")).alias("k", "n_tokens"), "ordinal")
    ended = whole.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    last = own.groupBy("file").agg(F.max(F.struct("block", "ordinal", "n_ends", "first", "tail")).alias("x")).select("file", "x.*")
    tail = last.select("file", (F.col("ordinal") + F.col("n_ends")).alias("ordinal"), F.when(F.col("n_ends") > 0, F.col("tail")).otherwise(F.col("first")).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.unionByName(tail.filter("n_tokens > 0"))


def _carried(rows: DataFrame, before, by: str, ends, tokens, left) -> DataFrame:
    """With the separators in earlier rows of a window, whether there are any, and the tokens since the last one."""
    total = F.coalesce(F.sum(tokens).over(before), F.lit(0))
    rows = rows.withColumns({"ordinal": F.coalesce(F.sum(ends).over(before), F.lit(0)), "total": total})
    # tokens up to the last separator: those of the row that has it, but for what it left open
    upto = F.coalesce(F.max(F.when(ends > 0, F.col("total") + tokens - left)).over(before), F.lit(0))
    return rows.withColumns({"carried": F.col("total") - upto, "seen": F.col("ordinal") > 0})


def read_token_files(spark: SparkSession, path: str, bits: int = 16, blocks_a_read: int = 64) -> DataFrame:
    """Blocks of the flat token files at path, a file or a folder. A file is cut into ranges of blocks_a_read blocks, which
    tasks read by their offsets, so a file may be of any size. Where the storage isn't one that Arrow can open, a file
    passes whole through one task and may have 2 GB at most. An empty file has no block."""
    size = BLOCK * bits // 8
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop) or []
    files = []
    for f in found:
        inner = f.getPath().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(f.getPath()) if f.isDirectory() else [f]
        files += [(g.getPath().toString(), g.getLen()) for g in inner if g.isFile() and not g.getPath().getName().startswith(("_", "."))]
    listed = spark.createDataFrame(files, "file string, size long").filter("size > 0")
    try:
        for name, _ in files[:1]:
            pa.fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file:///") else name)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_whole(size), "file string, block long, payload binary")
    ranges = listed.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {size * blocks_a_read}"))).alias("part"))
    return ranges.repartition("file", "part").mapInArrow(_ranged(size, blocks_a_read), "file string, block long, payload binary")


def _block(name: str, block: int, payload: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["file", "block", "payload"])


def _whole(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                data = content.as_buffer()
                for k in range(0, len(data), size):
                    yield _block(name.as_py(), k // size, data.slice(k, min(size, len(data) - k)).to_pybytes())

    return run


def _ranged(size: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, length, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                uri = "file://" + name.removeprefix("file:").removeprefix("//") if name.startswith("file:") else name
                system, at = pa.fs.FileSystem.from_uri(uri)
                with system.open_input_file(at) as f:
                    for block in range(part * blocks, (part + 1) * blocks):
                        if block * size >= length:
                            break
                        yield _block(name, block, f.read_at(min(size, length - block * size), block * size))

    return run


def _flatten(name: str, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's documents as one flat file in blocks, and apart from it their ids in order."""
        own, file = encoder(vocabulary_path(name), False), f"part-{TaskContext.get().partitionId():06d}"
        held, size, block, ordinal = [], 0, 0, 0
        end = np.array([separator], "<u2").tobytes()

        def row(block, payload, ids, ordinal):
            return pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], pa.int64()), pa.array([payload], pa.binary()), pa.array([ids], pa.list_(pa.int64())), pa.array([ordinal], pa.int64())],
                names=["file", "block", "payload", "ids", "ordinal"],
            )

        for batch in batches:
            for at, to in chunks(text_buffers(batch.column(1))[1], 1 << 22):
                part = batch.slice(at, to - at)
                with uncollected():
                    encoded = [raw for raw, _ in own.encode([t or "" for t in part.column(1).to_pylist()])]
                for raw in encoded:
                    held += [np.frombuffer(raw, "<u4").astype("<u2").tobytes(), end]
                    size += len(raw) // 2 + 2
                yield row(None, None, part.column(0).to_pylist(), ordinal)
                ordinal += len(part)
                flat = b"".join(held)
                whole = len(flat) // (2 * BLOCK)
                for k in range(whole):
                    yield row(block + k, flat[k * 2 * BLOCK : (k + 1) * 2 * BLOCK], None, None)
                block, held = block + whole, [flat[whole * 2 * BLOCK :]]
        own.rest()
        if held and held[0]:
            yield row(block, held[0], None, None)

    return run


def flatten(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Flat token files of docs, one a task, as blocks; and file, ordinal, doc_id. Written once, for a file's order is its task's.

    Whole texts are encoded, null as an empty text; strings of special tokens in a text are ordinary text, so
    the end-of-document id is only ever a separator.
    """
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    both = scratch.cut(rows.mapInArrow(_flatten(VOCABULARY, END_OF_DOCUMENT), "file string, block long, payload binary, ids array<long>, ordinal long"))
    named = both.filter("ids is not null").select("file", F.posexplode("ids").alias("k", "doc_id"), "ordinal")
    return both.filter("block is not null").select("file", "block", "payload"), named.select("file", (F.col("ordinal") + F.col("k")).alias("ordinal"), "doc_id")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    blocks, names = flatten(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark))
    return token_counts(blocks).join(names, ["file", "ordinal"]).select("doc_id", "n_tokens")
