"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are partitioned by the number of their shingles into classes of powers of two. For
a class of size s, each document is cut into windows of 2 s shingles that overlap by s, so that any
passage as long as an item lies whole in one window, whose similarity to the item is then bounded
from below however long the document is. An item and a window that agree in any of the minwise
values are a candidate; candidates are verified by exact containment of shingle sets.

Documents are never shuffled: the items go to them, in blocks of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import narrow_batches, tidy
from .shingles import distinct, shingle_hashes, text_words

#: Minwise values: an item at the containment 0.8 that is half as long as its class allows agrees with
#: its window in each with probability 0.19 or more, so none of 64 does in 1 case of 700 000.
K = 64
#: Items that are sent to the documents at once.
BLOCK = 20_000
_rng = np.random.default_rng(9)
_A = _rng.integers(0, 1 << 31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, K, dtype=np.uint32)


@dataclass
class Items:
    ids: list[int | None]
    sets: list[np.ndarray]
    #: by class: its size, and for each minwise function the sorted values, the items that have them, and a filter on the upper 16 bits
    classes: list[tuple[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]
    #: by number of words, for items too short for a shingle: sorted hashes of whole items, and their ids
    short: list[tuple[int, np.ndarray, list[int | None]]]


def prepare(ids: list, texts: list, size: int, short: bool = True) -> Items:
    kept_ids, sets, brief = [], [], {}
    for i, words in _words(ids, texts):
        if len(words) >= size:
            kept_ids.append(i)
            sets.append(distinct(shingle_hashes(words, size)))
        elif short and len(words):
            brief.setdefault(len(words), []).append((shingle_hashes(words, len(words))[0], i))
    whole = []
    for n, pairs in sorted(brief.items()):
        marks = np.array([m for m, _ in pairs], np.uint64)
        order = np.argsort(marks, kind="stable")
        whole.append((n, marks[order], [pairs[k][1] for k in order]))
    of = np.array([1 << int(len(x) - 1).bit_length() for x in sets], int)
    classes = []
    for s in sorted(set(of.tolist())):
        own, tables = np.flatnonzero(of == s), []
        for k in range(K):
            low = np.array([((sets[i] >> np.uint64(32)).astype(np.uint32) * _A[k] + _B[k]).min() for i in own], np.uint32)
            order = np.argsort(low, kind="stable")
            bits = np.zeros(1 << 16, bool)
            bits[low >> np.uint32(16)] = True
            tables.append((low[order], own[order], bits))
        classes.append((s, tables))
    return Items(kept_ids, sets, classes, whole)


def _words(ids: list, texts: list) -> Iterator[tuple[object, np.ndarray]]:
    for at, to, words, cuts in text_words(pa.array(texts, pa.string())):
        for k, a, b in zip(range(at, to), cuts[:-1], cuts[1:], strict=True):
            yield ids[k], words[a:b]


def candidates(tokens: np.ndarray, cuts: np.ndarray, items: Items) -> np.ndarray:
    """Codes document * items + item of the pairs that agree in a minwise value. tokens: the documents' shingles in order."""
    sizes, found = np.diff(cuts), [np.zeros(0, np.int64)]
    high = (tokens >> np.uint64(32)).astype(np.uint32)
    grids = []
    for s, tables in items.classes:
        blocks = -(-sizes // s)
        doc = np.repeat(np.arange(len(sizes)), blocks)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        grids.append((cuts[:-1][doc] + place * s, doc, doc[1:] == doc[:-1], tables))
    for k in range(K):
        value = high * _A[k] + _B[k]
        for starts, doc, next_same, tables in grids:
            if not len(starts):
                continue
            low = np.minimum.reduceat(value, starts)
            low[:-1] = np.where(next_same, np.minimum(low[:-1], low[1:]), low[:-1])
            mins, own, bits = tables[k]
            hit = np.flatnonzero(bits[low >> np.uint32(16)])
            a, b = np.searchsorted(mins, low[hit], "left"), np.searchsorted(mins, low[hit], "right")
            for h, x, y in zip(hit[a < b], a[a < b], b[a < b], strict=True):
                found.append(doc[h] * len(items.sets) + own[x:y])
    return np.unique(np.concatenate(found))


def _search(sent, size: int, percent: int, clean: int | None = None):
    """Rows of matches in rows of id and text; with clean, the place of the text, the rows without any match instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        for batch in batches:
            for at, to, words, cuts in text_words(batch.column(1 if clean is None else clean)):
                parts = [shingle_hashes(words[a:b], size) if b - a >= size else words[:0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)
                codes = candidates(np.concatenate(parts), offsets, items) if offsets[-1] and items.sets else np.zeros(0, np.int64)
                out, own, doc, dirty = [], None, -1, np.zeros(to - at, bool)
                for n, marks, short in items.short:
                    for d, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                        if b - a >= n:
                            runs = distinct(shingle_hashes(words[a:b], n))
                            place = np.searchsorted(runs, marks).clip(max=len(runs) - 1)
                            for k in np.flatnonzero(runs[place] == marks):
                                dirty[d] = True
                                out.append((None if clean is not None else batch.column(0)[at + d].as_py(), short[k], 1, 1))
                for code in codes.tolist():
                    d, i = divmod(code, len(items.sets))
                    if d != doc:
                        doc, own = d, distinct(parts[d])
                    want = items.sets[i]
                    place = np.searchsorted(own, want).clip(max=len(own) - 1)
                    shared = int(np.count_nonzero(own[place] == want))
                    if 100 * shared >= percent * len(want):
                        dirty[d] = True
                        out.append((None if clean is not None else batch.column(0)[at + d].as_py(), items.ids[i], len(want), shared))
                if clean is not None:
                    yield batch.slice(at, to - at).filter(pa.array(~dirty))
                elif out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "item_id", "n_item", "n_shared"])

    return run


def _blocks(items: DataFrame, item_col: str, item_text: str) -> Iterator[list]:
    """The items, at most BLOCK at once; one empty block if there are none."""
    items, block, any_ = items.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).filter("text is not null"), [], False
    for row in items.toLocalIterator():
        block.append(row)
        if len(block) == BLOCK:
            yield block
            block, any_ = [], True
    if block or not any_:
        yield block


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Rows doc_id, item_id, n_item, n_shared: documents that hold percent of an item's distinct shingles of size words.

    Words are lower-cased (A-Z) and split at ASCII white space. An item of fewer than size words is one shingle, all of
    its words, and is held by documents in which these follow each other. Items and documents without a word
    are in no row. Items of the same words are found alike, each in a row of its own. A repeated document row repeats its
    rows; null ids stay null. Either table empty: an empty result. Other columns are not read.

    The items are a stated query set: they pass through the driver in blocks of BLOCK, each searched for in
    all documents.
    """
    narrow_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = None
    for block in _blocks(items, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(prepare([r[0] for r in block], [r[1] for r in block], size))
        more = rows.mapInArrow(tidy(_search(sent, size, percent)), "doc_id long, item_id long, n_item long, n_shared long")
        found = more if found is None else found.unionByName(more)
    return found


def without_contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = 5, percent: int = 80, short: bool = True) -> DataFrame:
    """The rows of docs, with all their columns, that contamination() would name in no row. No shuffle. Without short, items
    of fewer than size words are passed over: a word or two alone are no sign of a leak."""
    narrow_batches(docs.sparkSession)
    out = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # Arrow maps know no dotted names
    for block in _blocks(items, item_col, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(prepare([r[0] for r in block], [r[1] for r in block], size, short))
        out = out.mapInArrow(tidy(_search(sent, size, percent, docs.columns.index(text_col))), out.schema)
    return out.toDF(*docs.columns)


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP9_SQL = r"""
WITH words AS (SELECT 'd' AS k, doc_id AS id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        UNION ALL
        SELECT 'b', item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') FROM benchmark),
sh AS (SELECT k, id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) >= 5),
item AS (SELECT id AS item_id, len(s) AS n_item, unnest(s) AS sh FROM sh WHERE k = 'b'),
doc AS (SELECT id AS doc_id, unnest(s) AS sh FROM sh WHERE k = 'd')
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM doc JOIN item USING (sh)
GROUP BY ALL HAVING 100 * count(*) >= 80 * n_item
UNION ALL
SELECT d.id, b.id, 1, 1 FROM words b JOIN words d ON b.k = 'b' AND d.k = 'd' AND len(b.w) BETWEEN 1 AND 4
  AND contains(concat(' ', array_to_string(d.w, ' '), ' '), concat(' ', array_to_string(b.w, ' '), ' '))
"""
