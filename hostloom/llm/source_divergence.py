"""Source divergence audit by two-dimensional group-block tiling.

Every (lang, source) group has a vector of term counts over the terms that its language keeps. The vectors are packed in
chunks of the vocabulary (positions and counts). The groups of a language are dealt into blocks; each pair of blocks is a
tile, to which the chunks of both blocks' groups are replicated, so a vector is sent once for each block and not once for
each other group. A tile's task unpacks one chunk of the vocabulary at a time into shares of integers and adds what the
chunk gives to the tile's submatrix of pairs. A tile's chunks are cut into stripes, whose submatrices are added up, so that
a language with most of the rows and few groups is spread over tasks too.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, narrow_batches, tidy

#: Shares are of so many parts.
PARTS = 1_000_000_000
#: Groups of a block, terms of a chunk, chunks of a stripe, and terms that a task counts before it lets go.
BLOCK, CHUNK, STRIPE, HELD = 32, 4096, 64, 1 << 18
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows lang, source, term, n, docs: what a task counts. Bytes of other characters become spaces, so one split finds the terms."""
    counts: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)
    size = 0

    def counted() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            words = list(own)
            for k in range(0, len(words), 1 << 14):
                part = words[k : k + (1 << 14)]
                columns = [pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string()), pa.array(part, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([own[w] for w in part], pa.int64()), pa.array([docs[lang, source][w] for w in part], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*batch.columns, strict=True):
            raw = text.as_buffer()
            if raw is None or not raw.size:
                continue
            words = raw.to_pybytes().translate(_LETTERS).split()
            key = lang.as_py(), source.as_py()
            own = counts[key]
            size -= len(own)
            own.update(words)
            docs[key].update(set(words))
            size += len(own)
            if size > HELD:
                yield from counted()
                counts.clear()
                docs.clear()
                size = 0
    yield from counted()


def shares(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(PARTS * (counts + 1) / whole), exactly: the quotient three decimal digits at a time, so that nothing overflows."""
    q, r = np.divmod(counts + 1, whole)
    for _ in range(3):
        step, r = np.divmod(r * 1000, whole)
        q = q * 1000 + step
    return q + 1


def share(counts: Column, whole: Column) -> Column:
    """The same as a column: an integral division of decimals."""
    return F.call_function("div", F.lit(PARTS).cast("decimal(10,0)") * (counts + 1).cast("decimal(19,0)"), whole.cast("decimal(19,0)")) + 1


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition, ordered by tile and chunk; gives a tile's submatrix of sums when the tile is over."""
    tile, chunk = None, None
    rows: list[dict] = []
    sums: dict[tuple[str, str], int] = defaultdict(int)

    def add() -> None:
        if not rows:
            return
        size = rows[0]["size"]
        p = np.empty((len(rows), size), np.int64)
        for own, r in zip(p, rows, strict=True):
            dense = np.zeros(size, np.int64)
            if r["at"] is not None:
                dense[r["at"]] = r["n"]
            own[:] = shares(dense, r["whole"])
        block = np.array([r["block"] for r in rows])
        names = [r["source"] for r in rows]
        low, high = rows[0]["low"], rows[0]["high"]
        for i, source in enumerate(names):
            # against the other block, or against the others of its own in a tile of one block
            others = np.flatnonzero(block != block[i]) if low != high else np.flatnonzero(np.arange(len(rows)) != i)
            if not len(others):
                continue
            q = p[others]
            f = (p[i] - q) ** 2 // q
            for j, v in zip(others.tolist(), f.sum(axis=1).tolist(), strict=True):
                sums[source, names[j]] += v
        rows.clear()

    def given() -> Iterator[pa.RecordBatch]:
        keys = list(sums)
        if keys:
            yield pa.RecordBatch.from_arrays(
                [pa.array([tile[0]] * len(keys)), pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys]), pa.array([sums[k] for k in keys], pa.int64())], names=["lang", "source", "item", "value"]
            )
        sums.clear()

    for batch in batches:
        langs, lows, highs, stripes, ks, sources, blocks, sizes, wholes = (batch.column(k).to_pylist() for k in range(9))
        for k in range(len(batch)):
            key = langs[k], lows[k], highs[k], stripes[k]
            if key != tile or ks[k] != chunk:
                add()
            if key != tile:
                yield from given()
            tile, chunk = key, ks[k]
            at, n = (batch.column(c)[k].values for c in (9, 10))
            rows.append({"source": sources[k], "block": blocks[k], "size": sizes[k], "whole": wholes[k], "low": lows[k], "high": highs[k], "at": None if at is None else at.to_numpy(), "n": None if n is None else n.to_numpy()})
    add()
    yield from given()


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 3, top: int = 200, block: int = BLOCK, chunk: int = CHUNK, stripe: int = STRIPE) -> DataFrame:
    """Rows lang, source, part, item, value, rank: how a source's use of terms departs from other sources and its language.

    A language keeps the terms that at least least_docs of its rows have. A group's share of a kept term is
    1 + floor(10^9 (count + 1) / (N + V)), N its count of kept terms and V their number, and f = floor((p - q)^2 / q).
    Part 'pair': f summed over all kept terms, for each other source of the language, all ranks. Part 'term': f against the
    language's share, for the group's own terms whose share is the larger, the first top ranks. Ranks go by value, the
    largest first, then by the item's bytes.

    Null lang, source and text count as ''. Rows stand for themselves: repeated ones count again. A language without kept
    terms has pairs of value 0; a source that is alone has no pair. An empty table gives an empty result. Other columns
    are not read. All numbers are integers and exact; one that would not fit in 64 bits ends in an error.

    block: groups of a block; chunk: terms of a chunk; stripe: chunks that a task takes of a tile.
    """
    spark = docs.sparkSession
    narrow_batches(spark)
    scratch = Scratch(spark)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    # one shuffle by (lang, term) serves both sums; a term has one row a source in the list
    terms = docs.mapInArrow(tidy(_terms), "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    terms = terms.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("all"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by")).filter(F.col("docs") >= least_docs)
    kept = scratch.cut(kept.select("lang", "term", "all", "by", F.pmod(F.xxhash64("term"), F.lit(1 << 12)).cast("int").alias("bin")))
    # each kept term's number in its language: bins of a hash in order, and the place in the bin
    bins = kept.groupBy("lang", "bin").agg(F.count("*").alias("size"))
    before = Window.partitionBy("lang").orderBy("bin")
    bins = bins.select("lang", "bin", (F.sum("size").over(before) - F.col("size")).alias("start"))
    place = F.row_number().over(Window.partitionBy("lang", "bin").orderBy("term"))
    numbered = kept.join(bins, ["lang", "bin"]).select("lang", (F.col("start") + place - 1).alias("id"), "by")
    wholes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("all").alias("total"))
    own = kept.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("own"))
    groups = docs.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(wholes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("own", F.lit(0)) + F.coalesce("v", F.lit(0))).alias("whole"), (F.col("total") + F.col("v")).alias("lang_whole"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    last = F.expr(f"cast((count(*) over (partition by lang) - 1) div {block} as int)")
    groups = scratch.cut(groups.withColumns({"block": F.floor(number / block).cast("int"), "last": last}))
    # packed vectors: every group has a row for every chunk of its language, for terms that it lacks have a share too
    packed = numbered.select("lang", F.expr(f"id div {chunk}").alias("chunk"), F.expr(f"cast(id % {chunk} as int)").alias("at"), F.explode("by").alias("x"))
    packed = packed.groupBy("lang", F.col("x.source").alias("source"), "chunk").agg(F.collect_list(F.struct("at", F.col("x.n").alias("n"))).alias("vector"))
    every = groups.select("lang", "source", "v", "whole", "block", "last", F.explode(F.expr(f"sequence(0L, greatest(v - 1, 0L) div {chunk})")).alias("chunk"))
    every = every.join(packed, ["lang", "source", "chunk"], "left").withColumn("size", F.expr(f"cast(least({chunk}L, v - chunk * {chunk}) as int)"))
    tiles = every.withColumn("other", F.explode(F.expr("sequence(0, last)"))).select(
        "lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.expr(f"chunk div {stripe}").alias("stripe"), "chunk", "source", "block", "size", "whole",
        F.col("vector.at").alias("at"), F.col("vector.n").alias("n"),
    )
    key = ["lang", "low", "high", "stripe"]
    sums = tiles.repartition(*key).sortWithinPartitions(*key, "chunk").mapInArrow(tidy(_tiled), "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    found = kept.select("lang", "term", "all", F.explode("by").alias("x")).select("lang", F.col("x.source").alias("source"), F.col("term").alias("item"), F.col("x.n").alias("n"), "all").join(groups.select("lang", "source", "whole", "lang_whole"), ["lang", "source"])
    found = found.select("lang", "source", "item", share(F.col("n"), F.col("whole")).alias("p"), share(F.col("all"), F.col("lang_whole")).alias("q")).filter("p > q")
    found = found.select("lang", "source", F.lit("term").alias("part"), "item", F.expr("(p - q) * (p - q) div q").alias("value")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(found.select(*columns))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(s, 0)::HUGEINT AS s FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS s FROM c GROUP BY ALL) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s + v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (kept.n + 1)) // (total + v)::HUGEINT AS q
      FROM g JOIN v USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x) WHERE part = 'pair' OR rank <= 200
"""
