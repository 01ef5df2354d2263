"""Texts as tensors of a fixed shape: ids of words, filled up to a length, with a mask; and models that take them batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids of what fills up, and of a word that the vocabulary doesn't have; the vocabulary's own begin after them.
FILL, UNKNOWN = 0, 1


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(\w+)"))


def vocabulary(texts: DataFrame, most: int = 1000, text_col: str = "text") -> DataFrame:
    """Rows word, word_id: the most frequent words of all texts, ties by the word, most at most."""
    counted = texts.select(F.explode(words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    few = counted.orderBy(F.desc("n"), "word").limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("x"))  # most rows
    return few.select(F.posexplode("x").alias("k", "x")).select("x.word", (F.col("k") + UNKNOWN + 1).cast("int").alias("word_id"))


def encoded(texts: DataFrame, known: DataFrame, length: int = 32, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Rows id, n, ids, mask: how many words a text has, the ids of its first length words, filled up to length, and 1 for each id that is a word's.
    A null text has no words. known: vocabulary(), which is broadcast, for its size has a bound."""
    own = texts.select(F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    each = own.select("id", F.posexplode(F.slice("w", 1, length)).alias("k", "word")).join(F.broadcast(known), "word", "left")
    found = each.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("word_id", F.lit(UNKNOWN)).alias("v")))).alias("x")).select("id", F.transform("x", lambda x: x["v"]).alias("v"))
    rows = own.select("id", F.size("w").alias("n")).join(found, "id", "left").withColumn("v", F.coalesce("v", F.array().cast("array<int>")))
    filled = lambda c, x: F.slice(F.concat(c, F.array_repeat(F.lit(x), length)), 1, length)
    return rows.select("id", "n", filled(F.col("v"), FILL).alias("ids"), filled(F.transform("v", lambda x: F.lit(1)), 0).alias("mask"))


def embedded(tensors: DataFrame, model: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """Rows id, vector: model(ids, mask), two matrices with a row a text, gives a matrix of vectors; it is called with an Arrow batch at a time."""
    kind = tensors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids, mask = (batch.column(k).flatten().to_numpy().reshape(len(batch), -1) for k in (1, 2))
                out = np.asarray(model(ids, mask), np.float64)
                at = pa.array(np.arange(0, out.size + 1, out.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(at, pa.array(out.ravel()))], names=["id", "vector"])

    return tensors.select("id", "ids", "mask").mapInArrow(run, f"id {kind}, vector array<double>")


def mean_of_hashes(size: int = 64) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A model without training: the mean of a fixed vector of each id, the same wherever it runs."""

    def run(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        slot = (ids.astype(np.uint64)[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)
        vectors = slot / float(1 << 23) - 1
        return (vectors * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1), 1)[:, None]

    return run
