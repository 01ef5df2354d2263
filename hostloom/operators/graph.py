"""Graph operators on vertices (id) and directed edges (source, target, type, confidence)."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pieces
from .lineage import cut, forget

#: Edges and vertices up to which ranks are iterated as arrays within a task; parts that a component is ordered in; sources that are searched from at once.
SMALL, SALTS, SOURCES = 1 << 20, 64, 8192
#: Sources and vertices of a block of searches, and blocks of vertices that a row of edges leads to.
STRIP, WIDE, SPAN = 256, 1024, 64
#: Sources and places (source and vertex) that a task searches from at once in a graph of up to SMALL edges, and edges that it follows at once.
AT_ONCE, PLACES, FOLLOWED = 64, 1 << 22, 1 << 15
#: Edges of a graph that is searched in pieces, and of all tasks of it together; edges that are worth a task.
PIECED, WORTH = 1 << 25, 1 << 16


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source").alias("a"), F.col("target").alias("b")).union(edges.select("target", "source"))


def simple(edges: DataFrame) -> DataFrame:
    """Undirected, without repeats and loops: a < b."""
    return edges.filter("source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def with_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The vertices and the ends of edges that are not among them."""
    return vertices.select("id").union(edges.select("source")).union(edges.select("target")).filter("id is not null").distinct()


def measures(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: counts, density of the directed graph and mean total degree."""
    v, e = vertices.agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("m"))
    n, m = F.col("n"), F.col("m")
    return v.crossJoin(e).select("n", "m", F.when(n > 1, m / (n * (n - 1))).otherwise(0.0).alias("density"), F.when(n > 0, 2 * m / n).alias("degree"))  # two single rows


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars: each vertex that hangs together with a smaller one in the partition, and the smallest of these."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    for part in itertools.batched(list(up), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([root(x) for x in part], pa.string())], names=["a", "b"])


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: the smallest id that can be reached, directions ignored. Each partition's edges are first replaced by stars of
    what hangs together there; then steps alternate that pull the larger and the smaller neighbours of each vertex to its least one. Rounds grow
    with the logarithm of the longest path."""
    e = cut(simple(edges).mapInArrow(_forest, "a string, b string").distinct())  # a > b
    last = None
    while True:
        sym = e.union(e.select("b", "a"))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(sym.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        after = cut(large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct())
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(e, large)
        e = after
        if now == last or not now[0]:
            break
        last = now
    return vertices.select("id").join(e.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Per vertex the clustering coefficient of the undirected projection. Edges point from the end of the lower degree to that of
    the higher one (ties by id), so that no vertex has more than the root of twice the edges going out and a hub forms no wedges."""
    e = cut(simple(edges))
    degree = cut(e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d")))
    ends = e.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    forward = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = cut(ends.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("high")))
    wedges = out.alias("x").join(out.alias("y"), "low").filter("x.high < y.high").select("low", F.col("x.high").alias("a"), F.col("y.high").alias("b"))
    count = wedges.join(e, ["a", "b"]).select(F.explode(F.array("low", "a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("t"))
    rows = vertices.select("id").join(degree, "id", "left").join(count, "id", "left")
    return rows.select("id", F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("clustering"))


def degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Total degree, parallel edges counted, and as a share of the other vertices."""
    d = edges.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    n = vertices.agg(F.count("*").alias("n"))  # one row
    return vertices.select("id").join(d, "id", "left").crossJoin(n).select("id", F.coalesce("degree", F.lit(0)).alias("degree"), (F.coalesce("degree", F.lit(0)) / (F.col("n") - 1)).alias("centrality"))


def pagerank(vertices: DataFrame, edges: DataFrame, rounds: int = 200, alpha: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """id, rank: power iteration until the ranks change by less than tolerance in sum, or for rounds; parallel edges add
    up, dangling mass is spread evenly. A graph of up to SMALL edges is iterated as arrays in one task, a larger one by
    one join and one aggregation a round, with the lineage cut and the mass taken in the same pass. The joins are merges: a broadcast
    would send all ranks through the driver, round after round."""
    vertices, edges = cut(vertices.select("id").distinct()), cut(edges.select("source", "target"))
    if _is_small(vertices, edges):

        def run(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> dict[str, np.ndarray]:
            n, out = len(ids), np.bincount(a, minlength=len(ids))
            rank = np.full(n, 1 / max(n, 1))
            for _ in range(rounds):
                got = np.bincount(b, rank[a] / out[a], n)
                after = alpha * (got + rank[out == 0].sum() / n) + (1 - alpha) / n
                rank, change = after, np.abs(after - rank).sum()
                if change < tolerance:
                    break
            return {"id": ids, "rank": rank}

        return _whole(vertices, edges, run, "id string, rank double", distinct=False)
    out = edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("out"))
    n = vertices.count()
    state = cut(vertices.join(out.hint("merge"), "id", "left").withColumn("rank", F.lit(1 / n)))
    lost = state.filter("out is null").agg(F.sum("rank")).first()[0] or 0.0
    for _ in range(rounds):
        sent = edges.join(state.withColumnRenamed("id", "source").hint("merge"), "source").groupBy(F.col("target").alias("id")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        rank = alpha * (F.coalesce("got", F.lit(0.0)) + F.lit(lost / n)) + (1 - alpha) / n
        after = cut(state.withColumnRenamed("rank", "old").join(sent.hint("merge"), "id", "left").select("id", "out", "old", rank.alias("rank")))
        change, lost = after.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.sum(F.when(F.col("out").isNull(), F.col("rank")))).first()
        lost = lost or 0.0
        forget(state)
        state = after.select("id", "out", "rank")
        state._hostloom_path = after._hostloom_path
        if change < tolerance:
            break
    return state.select("id", "rank")


def reach(edges: DataFrame, start: str, depth: int | None = None, backwards: bool = False) -> DataFrame:
    """id, hops of all vertices that can be reached from start, which itself is left out; breadth first, by frontier joins."""
    e = edges.select(F.col("target").alias("a"), F.col("source").alias("b")) if backwards else edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    e = cut(e.distinct())
    seen = edges.sparkSession.createDataFrame([(start, 0)], "id string, hops int")
    frontier, hops = seen, 0
    while depth is None or hops < depth:
        hops += 1
        found = e.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = cut(found.join(seen, "id", "left_anti").select("id", F.lit(hops).alias("hops")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.filter(F.col("hops") > 0)


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    up = edges.filter(F.col("target") == node).select(F.lit("upstream").alias("direction"), F.col("source").alias("id"), "type", "confidence")
    return up.union(edges.filter(F.col("source") == node).select(F.lit("downstream"), F.col("target"), "type", "confidence"))


def impact(edges: DataFrame, node: str, membership: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """One row: direct neighbours, everything downstream, the communities that are hit, and how many critical paths
    (rows start, end, path) hold the node or something downstream of it."""
    down = cut(reach(edges, node))
    hit = down.join(membership, "id").agg(F.count_distinct("component").alias("communities"))
    direct = neighbours(edges, node).agg(F.count_distinct("id").alias("neighbours"))
    one = direct.crossJoin(down.agg(F.count("*").alias("downstream"))).crossJoin(hit)  # single rows
    if paths is None:
        return one
    on = paths.select("start", "end", F.explode("path").alias("id"))
    hurt = on.join(down.select("id").union(edges.sparkSession.createDataFrame([(node,)], "id string")), "id", "left_semi").select("start", "end").distinct()
    return one.crossJoin(hurt.agg(F.count("*").alias("critical_paths")))


def shortest_paths(edges: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows start, end, path, length: for each pair the shortest path, the first by names of equally long ones; no row if
    end can't be reached. All starts go on together, by frontier joins that keep one path for each start and vertex."""
    spark = edges.sparkSession
    e = cut(edges.select("source", "target").distinct())
    seen = spark.createDataFrame([(s, s, [s]) for s in sorted({s for s, _ in pairs})], "start string, id string, path array<string>")
    wanted = F.broadcast(spark.createDataFrame(pairs, "start string, end string").distinct())  # a stated list
    parts, frontier = [seen], seen
    while True:
        open_ = wanted.join(seen.select("start", F.col("id").alias("end")), ["start", "end"], "left_anti").select("start").distinct()
        found = e.join(frontier.join(open_, "start", "left_semi").withColumnRenamed("id", "source"), "source").groupBy("start", F.col("target").alias("id")).agg(F.min(F.concat("path", F.array("target"))).alias("path"))
        frontier = cut(found.join(seen.select("start", "id"), ["start", "id"], "left_anti"))
        if frontier.isEmpty():
            break
        parts.append(frontier)
        seen = reduce(lambda a, b: a.unionByName(b), parts)
    return wanted.join(seen.withColumnRenamed("id", "end"), ["start", "end"]).select("start", "end", "path", (F.size("path") - 1).alias("length"))


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """One row path, length; no row if end can't be reached."""
    return shortest_paths(edges, [(start, end)]).select("path", "length")


def critical_paths(edges: DataFrame, critical: list[str]) -> DataFrame:
    """Shortest paths of more than two vertices between critical ones: from each of the first five to those that
    follow it, up to the sixth."""
    pairs = [(a, b) for k, a in enumerate(critical[:5]) for b in critical[k + 1 : 6]]
    if not pairs:
        return edges.sparkSession.createDataFrame([], "start string, end string, path array<string>, length int")
    return shortest_paths(edges, pairs).filter("length > 1")


def communities(membership: DataFrame, edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """Per component: size, internal edges, density, twenty members at most and the most common environment."""
    size = membership.groupBy("component").agg(F.count("*").alias("size"))
    inside = edges.join(membership.withColumnRenamed("id", "source"), "source").groupBy("component").agg(F.count("*").alias("internal"))
    common = membership.join(hosts.select(F.col("hostname").alias("id"), "environment"), "id").groupBy("component", "environment").agg(F.count("*").alias("k"))
    common = common.groupBy("component").agg(F.min_by("environment", F.struct(-F.col("k"), "environment")).alias("environment"))
    # the twenty smallest of each salted part, then of the component: no task orders a whole component
    few = membership.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    for keys in (["component", "salt"], ["component"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
        few = few.withColumn("rn", rank).filter("rn <= 20")
    members = few.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("members"))
    rows = size.join(inside, "component", "left").join(common, "component", "left").join(members, "component")
    internal = F.coalesce("internal", F.lit(0))
    return rows.select("component", "size", internal.alias("internal"), F.when(F.col("size") > 1, internal / (F.col("size") * (F.col("size") - 1))).otherwise(0.0).alias("density"), "environment", "members")


def _whole(vertices: DataFrame, edges: DataFrame, f: Callable[..., dict[str, np.ndarray]], schema: str, distinct: bool = True) -> DataFrame:
    """f on the arrays of a graph, its ids in order and the places of its edges' ends among them, in one task.
    Callers have checked the graph's size."""
    ends = edges.select("source", "target").filter("source <> target").distinct() if distinct else edges.select("source", "target")
    rows = vertices.select(F.col("id").alias("a"), F.lit(None).cast("string").alias("b")).union(ends)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids = np.sort(g.a[g.b.isna()].unique().astype(str))
        pairs = g[g.b.notna()]
        a, b = (np.searchsorted(ids, pairs[c].to_numpy().astype(str)) for c in "ab") if len(pairs) else (np.zeros(0, int), np.zeros(0, int))
        if len(pairs):
            known = (ids[a.clip(max=len(ids) - 1)] == pairs.a.to_numpy().astype(str)) & (ids[b.clip(max=len(ids) - 1)] == pairs.b.to_numpy().astype(str)) if len(ids) else np.zeros(len(pairs), bool)
            a, b = a[known], b[known]
        return pd.DataFrame(f(ids, a, b))

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(lambda g: run(g[["a", "b"]]), schema)


@dataclass
class _Blocks:
    """A graph in blocks. Rows of searches are strip, block, at, value: of STRIP sources and a block of vertices, the places that matter
    (source * wide + vertex, both within their blocks) and their values."""

    place: DataFrame  # id, block, k: a vertex's block and its place there
    edges: DataFrame  # block, ahead, salt, a, tos, b: edges from a block's places to places of other blocks, forward (ahead) or back
    wide: int
    strip: int
    strips: int  # of a block
    salts: int = 8

    def push(self, rows: DataFrame, ahead: bool) -> DataFrame:
        """Values go along the edges and are added where edges meet: strip, block, at, value."""
        strip, wide = self.strip, self.wide

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, own in enumerate(batch.column(0).to_pylist()):
                    at, value, a, tos, b = (batch.column(c)[n].values.to_numpy() for c in range(1, 6))
                    s, v = at // wide, at % wide
                    for to in np.unique(tos):
                        low, high = np.searchsorted(tos, to), np.searchsorted(tos, to, "right")
                        first = np.searchsorted(a[low:high], v) + low
                        many = np.searchsorted(a[low:high], v, "right") + low - first
                        sent = int(many.sum())
                        if not sent:
                            continue
                        each = np.arange(sent) + np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
                        got = np.bincount(np.repeat(s * wide, many) + b[each], np.repeat(value, many), strip * wide)
                        full = np.flatnonzero(got)
                        yield _block(own, int(to), full, got[full])

        edges = self.edges.filter(F.col("ahead") == ahead).drop("ahead").hint("shuffle_hash")
        joined = rows.withColumn("salt", F.pmod("strip", F.lit(self.salts))).join(edges, ["block", "salt"])
        return joined.select("strip", "at", "value", "a", "tos", "b").mapInArrow(run, _ROWS)

    def fold(self, pushed: DataFrame, state: DataFrame, f: Callable[[np.ndarray, list], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """f on what is pushed to each strip and block, summed, and the row of state (strip, block and more) there or none. Rows come in order
        and are added as they come, so a task holds one block."""
        size, names = self.strip * self.wide, [c for c in state.columns if c not in ("strip", "block")]
        left = pushed.select("strip", "block", F.lit(0).alias("kind"), "at", "value", *(F.lit(None).cast(state.schema[c].dataType).alias(f"s_{c}") for c in names))
        right = state.select("strip", "block", F.lit(1), F.lit(None).cast("array<int>"), F.lit(None).cast("array<double>"), *names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, total, held = None, None, None
            for batch in batches:
                for n, (strip, block, kind) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                    if key != (strip, block):
                        if key:
                            yield from f(total, held, *key)
                        key, total, held = (strip, block), np.zeros(size), None
                    if kind:
                        held = [batch.column(5 + c)[n] for c in range(len(names))]
                    else:
                        total[batch.column(3)[n].values.to_numpy()] += batch.column(4)[n].values.to_numpy()
            if key:
                yield from f(total, held, *key)

        return left.union(right).repartition("strip", "block").sortWithinPartitions("strip", "block").mapInArrow(run, schema)

    def named(self, sums: DataFrame, part: Column, scale: Column) -> DataFrame:
        """id, part from rows block, k, part."""
        return self.place.join(sums.groupBy("block", "k").agg(part.alias("x")), ["block", "k"]).select("id", scale.alias("part"))


_ROWS = "strip int, block int, at array<int>, value array<double>"


def _block(strip: int, block: int, at: np.ndarray, value: np.ndarray, **more: pa.Array) -> pa.RecordBatch:
    """One row of searches."""
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (at.astype(np.int32), value.astype(np.float64))]
    return pa.RecordBatch.from_arrays([pa.array([strip], pa.int32()), pa.array([block], pa.int32()), *lists, *more.values()], names=["strip", "block", "at", "value", *more])


def _places(vertices: DataFrame) -> DataFrame:
    """id, block, k: vertices by blocks of WIDE about."""
    parts = max(1, -(-vertices.count() // WIDE))
    own = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    return cut(vertices.select("id", own.alias("block")).withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("id")) - 1))


def _blocks(vertices: DataFrame, edges: DataFrame) -> _Blocks:
    place = _places(vertices)
    wide = (place.agg(F.max("k")).first()[0] or 0) + 1
    strip = min(STRIP, SOURCES, wide)
    end = lambda c: place.select(F.col("id").alias(c), F.col("block").alias(f"{c}_block"), F.col("k").alias(f"{c}_k"))
    e = edges.join(end("source"), "source").join(end("target"), "target")
    one = lambda a, b, ahead: F.struct(F.lit(ahead).alias("ahead"), F.col(f"{a}_block").alias("block"), F.col(f"{b}_block").alias("to"), F.col(f"{a}_k").alias("a"), F.col(f"{b}_k").alias("b"))
    both = e.select(F.explode(F.array(one("source", "target", True), one("target", "source", False))).alias("x")).select("x.*")
    rows = both.groupBy("ahead", "block", F.floor(F.col("to") / SPAN)).agg(F.array_sort(F.collect_list(F.struct("to", "a", "b"))).alias("x"))
    salts = _Blocks.salts
    rows = rows.select("ahead", "block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.col("x.a").alias("a"), F.col("x.to").alias("tos"), F.col("x.b").alias("b"))
    return _Blocks(place, cut(rows), wide, strip, -(-wide // strip), salts)


def _searches(vertices: DataFrame, edges: DataFrame) -> Iterator[tuple[_Blocks, list[DataFrame]]]:
    """Breadth-first searches from all vertices, SOURCES at a time, in blocks: for each part of the sources the levels, tables of strip, block, at, value (how many
    shortest paths). A task holds one block of sources and vertices; n searches take their time. Levels are gone when the next part begins."""
    g = _blocks(vertices, edges)
    wide = g.wide
    parts = max(1, -(-vertices.count() // SOURCES))
    strip = (F.col("block") * g.strips + F.floor(F.col("k") / g.strip)).cast("int")
    starts = g.place.select(strip.alias("strip"), "block", ((F.col("k") % g.strip) * wide + F.col("k")).alias("at")).groupBy("strip", "block").agg(F.array_sort(F.collect_list("at")).alias("at"))

    def found(total: np.ndarray, held: list | None, strip: int, block: int) -> Iterator[pa.RecordBatch]:
        seen = np.unpackbits(np.frombuffer(held[0].as_py(), np.uint8), count=len(total)).astype(bool) if held else np.zeros(len(total), bool)
        full = np.flatnonzero((total > 0) & ~seen)
        seen[full] = True
        yield _block(strip, block, full, total[full], seen=pa.array([np.packbits(seen).tobytes()], pa.binary()))

    def begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for strip, block, at in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                total = np.zeros(size)
                total[at] = 1.0
                yield from found(total, None, strip, block)

    size = g.strip * wide
    for k in range(parts):
        levels = [cut(starts.filter(F.pmod("strip", F.lit(parts)) == k).mapInArrow(begun, _ROWS + ", seen binary"))]
        while True:
            front = levels[-1].filter("size(at) > 0").select("strip", "block", "at", "value")
            after = cut(g.fold(g.push(front, True), levels[-1].select("strip", "block", "seen"), found, _ROWS + ", seen binary"))
            levels.append(after)
            if after.filter("size(at) > 0").isEmpty():
                break
        yield g, [x.filter("size(at) > 0").select("strip", "block", "at", "value") for x in levels[:-1]]
        forget(*levels)


def _is_small(vertices: DataFrame, edges: DataFrame) -> bool:
    return edges.limit(SMALL + 1).count() <= SMALL and vertices.limit(SMALL + 1).count() <= SMALL


def _numbered(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """id, k: numbers of vertices; and rows a, b: edges by numbers, in SALTS lists about."""
    place = _places(vertices)
    wide = (place.agg(F.max("k")).first()[0] or 0) + 1
    number = (F.col("block") * wide + F.col("k")).cast("int")
    end = lambda c, to: place.select(F.col("id").alias(c), number.alias(to))
    ends = edges.join(end("source", "a"), "source").join(end("target", "b"), "target").select("a", "b")
    packed = ends.groupBy(F.pmod(F.hash("a", "b"), F.lit(SALTS)).alias("salt")).agg(F.collect_list(F.struct("a", "b")).alias("x"))
    return place.select("id", number.alias("k")), cut(packed.select(F.col("x.a").alias("a"), F.col("x.b").alias("b")))


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of vertices that have edges, and the places of edges' ends among them."""
    a, b = (rows.column(c).combine_chunks().flatten().to_numpy() for c in "ab")
    known = np.unique(np.concatenate([a, b]))
    return known, *(np.searchsorted(known, x).astype(np.int32) for x in (a, b))


def _each(packed: DataFrame, tasks: int) -> DataFrame:
    """The edges for each of so many tasks."""
    return packed.crossJoin(F.broadcast(packed.sparkSession.range(tasks).select(F.col("id").cast("int").alias("task")))).groupBy("task")  # numbers of tasks


def _in_pieces(vertices: DataFrame, edges: DataFrame, close: bool) -> DataFrame | None:
    """id and what searches from all vertices tell: part, what they owe to a vertex, or (close) r and far, how many vertices one reaches and the sum of their
    distances. None if the graph has more than PIECED edges or doesn't fall into pieces (pieces.hubs). Each task is sent the edges and searches in its share of
    the pieces, in fewer tasks the more edges there are."""
    m = edges.count()
    if not 0 < m <= PIECED:
        return None
    place, packed = _numbered(vertices, edges)
    kinds = pa.schema([("k", pa.int32()), *([("r", pa.int64()), ("far", pa.int64())] if close else [("part", pa.float64())])])
    schema = "k int, r long, far long" if close else "k int, part double"
    table = lambda *columns: pa.table([pa.array(c, t) for c, t in zip(columns, kinds.types, strict=True)], schema=kinds)

    def found(key: tuple, rows: pa.Table) -> pa.Table:
        known, a, b = _unpacked(rows)
        hubs = pieces.hubs(a, b, len(known))
        return pa.table({"k": pa.array([-1] if hubs is None else known[hubs], pa.int32())})

    hubs = np.array([r.k for r in _each(packed, 1).applyInArrow(found, "k int").collect()], np.int32)  # a few
    if -1 in hubs:
        return None
    q, tasks = len(hubs), max(1, min(m // WORTH, PIECED // m, edges.sparkSession.sparkContext.defaultParallelism))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        known, a, b = _unpacked(rows)
        g = pieces.Pieces(a, b, len(known), np.searchsorted(known, hubs), counted=not close)
        if close:
            source, r, far = g.reached(key[0].as_py(), tasks)
            return table(known[source], r, far)
        owed, leaps = g.owed(key[0].as_py(), tasks)
        full, ways = np.flatnonzero(owed), np.flatnonzero(leaps)
        return table(np.concatenate([known[full], -1 - ways]), np.concatenate([owed[full], leaps.ravel()[ways]]))

    told = cut(_each(packed, tasks).applyInArrow(run, schema))
    if not close:
        leaps = np.zeros(q * q)
        for r in told.filter("k < 0").groupBy("k").agg(F.sum("part").alias("part")).collect():  # two hubs a row
            leaps[-1 - r.k] = r.part

        def across(key: tuple, rows: pa.Table) -> pa.Table:
            known, a, b = _unpacked(rows)
            owed = pieces.Pieces(a, b, len(known), np.searchsorted(known, hubs)).across(leaps.reshape(q, q))
            return table(known[full := np.flatnonzero(owed)], owed[full])

        if leaps.any():
            told = told.filter("k >= 0").union(_each(packed, 1).applyInArrow(across, schema))
        # what cancels out leaves traces of either sign
        told = told.groupBy("k").agg(F.greatest(F.sum("part"), F.lit(0.0)).alias("part"))
    return place.join(told, "k").drop("k")


def _dealt(vertices: DataFrame, edges: DataFrame, f: Callable[[np.ndarray, np.ndarray, int, np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """id and the columns of schema: f on a graph of up to SMALL edges as arrays (its edges' ends, how many vertices) and on a part of the vertices that
    have edges going out. The sources are dealt over tasks, each of which is sent the edges; callers have checked the graph's size. f tells of
    places, in column k."""
    place, packed = _numbered(vertices, edges)
    tasks = max(1, min(-(-vertices.count() // AT_ONCE), 4 * vertices.sparkSession.sparkContext.defaultParallelism))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        known, a, b = _unpacked(rows)
        own = np.unique(a)[key[0].as_py() :: tasks]
        some = max(1, min(AT_ONCE, PLACES // max(len(known), 1)))
        out = [f(a, b, len(known), own[k : k + some]) for k in range(0, len(own), some)]
        told = {c: np.concatenate([x[c] for x in out]) for c in out[0]} if out else {}
        if told:
            told["k"] = known[told["k"]]
        return pa.table({c.name: pa.array(told.get(c.name, []), c.type) for c in kinds})

    kinds = pa.schema([("k", pa.int32()), *((c.split()[0], pa.int64() if c.endswith("long") else pa.float64()) for c in schema.split(", "))])
    told = _each(packed, tasks).applyInArrow(run, f"k int, {schema}")
    return place.join(told, "k").drop("k")


def _pusher(a: np.ndarray, b: np.ndarray, add: np.ufunc) -> Callable[[np.ndarray], np.ndarray]:
    """What a row a vertex becomes when each edge carries its row from a to b, where rows are added."""
    order = np.argsort(b, kind="stable")
    a, b = a[order], b[order]

    def push(rows: np.ndarray) -> np.ndarray:
        got = np.zeros_like(rows)
        on = rows.any(1)[a]
        s, t = a[on], b[on]
        for k in range(0, len(s), FOLLOWED):
            to = t[k : k + FOLLOWED]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            got[to[first]] = add(got[to[first]], add.reduceat(rows[s[k : k + FOLLOWED]], first, axis=0))
        return got

    return push


def _owed_at_once(a: np.ndarray, b: np.ndarray, n: int, sources: np.ndarray) -> dict[str, np.ndarray]:
    """k, part: what the searches from sources owe to each vertex."""
    ahead, back = _pusher(a, b, np.add), _pusher(b, a, np.add)
    far, paths = np.full((n, len(sources)), -1, np.int32), np.zeros((n, len(sources)))
    far[sources, np.arange(len(sources))], paths[sources, np.arange(len(sources))] = 0, 1.0
    front, hops = paths, 0
    while True:
        got = ahead(front)
        new = (far < 0) & (got > 0)
        if not new.any():
            break
        hops += 1
        far[new] = hops
        front = np.where(new, got, 0.0)
        paths = paths + front
    owed = np.zeros_like(paths)
    for h in range(hops, 1, -1):
        got = back(np.divide(1 + owed, paths, out=np.zeros_like(paths), where=far == h))
        owed += np.where(far == h - 1, paths * got, 0.0)
    part = owed.sum(1)
    full = np.flatnonzero(part)
    return {"k": full, "part": part[full]}


def _reached_at_once(a: np.ndarray, b: np.ndarray, n: int, sources: np.ndarray) -> dict[str, np.ndarray]:
    """k, r, far: how many vertices each of up to 64 sources reaches, and the sum of their distances; a bit a source."""
    ahead = _pusher(a, b, np.bitwise_or)
    seen = np.zeros((n, 1), np.uint64)
    seen[sources, 0] = np.uint64(1) << np.arange(len(sources), dtype=np.uint64)
    front, hops, r, far = seen, 0, np.zeros(64, np.int64), np.zeros(64, np.int64)
    while front.any():
        hops += 1
        front = ahead(front) & ~seen
        seen = seen | front
        held = front[front[:, 0] > 0].astype("<u8").view(np.uint8)
        new = np.unpackbits(held, axis=1, bitorder="little").sum(0, dtype=np.int64)
        r, far = r + new, far + hops * new
    return {"k": sources, "r": r[: len(sources)], "far": far[: len(sources)]}


def _counted(rows: DataFrame, f: Callable[[int, int, np.ndarray, np.ndarray], tuple[int, np.ndarray]]) -> DataFrame:
    """Rows block, k, part: f tells of a row of searches a block and a number for each place there, of which those over zero are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, (strip, block) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True)):
                own, first, part = f(strip, block, *(batch.column(c)[n].values.to_numpy() for c in (2, 3)))
                full = np.flatnonzero(part)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), own, np.int32)), pa.array((first + full).astype(np.int32)), pa.array(part[full].astype(np.float64))], names=["block", "k", "part"])

    return rows.select("strip", "block", "at", "value").mapInArrow(run, "block int, k int, part double")


def _summed(vertices: DataFrame, parts: list[DataFrame], column: str, scale: float) -> DataFrame:
    sums = reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.sum("part").alias("part"))
    return vertices.select("id").join(sums, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias(column))


def _owed(vertices: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Rows id, part: what the searches from each part of the sources owe to a vertex, level by level from the last one back."""
    out = []

    def back(total: np.ndarray, held: list | None, strip: int, block: int) -> Iterator[pa.RecordBatch]:
        if held:
            at, paths = (x.values.to_numpy() for x in held)
            owed = paths * total[at]
            yield _block(strip, block, at, (1 + owed) / paths, owed=pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(owed)))

    for g, levels in _searches(vertices, edges):
        wide, made, below = g.wide, [], None
        for upper in levels[:0:-1]:
            if below is None:
                below = upper.select("strip", "block", "at", F.transform("value", lambda x: 1 / x).alias("value"))
            else:
                below = cut(g.fold(g.push(below.select("strip", "block", "at", "value"), False), upper.select("strip", "block", "at", F.col("value").alias("paths")), back, _ROWS + ", owed array<double>"))
                made.append(below)
        if made:
            each = [_counted(x.select("strip", "block", "at", F.col("owed").alias("value")), lambda strip, block, at, value, w=wide: (block, 0, np.bincount(at % w, value, w))) for x in made]
            out.append(cut(g.named(reduce(DataFrame.unionAll, each), F.sum("part"), F.col("x"))))
            forget(*made)
    return out or [vertices.select("id", F.lit(0.0).alias("part"))]


def _close(vertices: DataFrame, edges: DataFrame) -> list[DataFrame]:
    """Rows id, part: the closeness of each source of _searches."""
    n, out = vertices.count(), []
    for g, levels in _searches(vertices, edges):
        wide, strip, strips = g.wide, g.strip, g.strips
        per = lambda own, block, at, value: (own // strips, own % strips * strip, np.bincount(at // wide, minlength=strip))
        each = [_counted(x, per).select("block", "k", F.struct(F.col("part").alias("r"), (F.col("part") * hops).alias("far")).alias("part")) for hops, x in enumerate(levels) if hops]
        if each:
            sums = F.struct(F.sum("part.r").alias("r"), F.sum("part.far").alias("far"))
            out.append(cut(g.named(reduce(DataFrame.unionAll, each), sums, F.col("x.r") / F.col("x.far") * F.col("x.r") / (n - 1))))
    return out or [vertices.select("id", F.lit(0.0).alias("part"))]


def betweenness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of shortest paths through each vertex; dependencies are summed from each source. A graph that falls into pieces without a few hubs is searched
    piece by piece; in another of up to SMALL edges each task searches from its sources through arrays, in a larger one searches go by joins of blocks."""
    vertices, edges = cut(vertices.select("id").distinct()), cut(edges.select("source", "target").filter("source <> target").distinct())
    n = vertices.count()
    owed = _in_pieces(vertices, edges, close=False)
    if owed is None:
        owed = _dealt(vertices, edges, _owed_at_once, "part double") if _is_small(vertices, edges) else None
    owed = _owed(vertices, edges) if owed is None else [owed]
    return _summed(vertices, owed, "betweenness", 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0)


def closeness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """By distances towards each vertex, scaled by the share of vertices that reach it. No rows unless the graph is weakly
    connected: there is nothing to compare vertices by whose worlds differ."""
    vertices, edges = cut(vertices.select("id").distinct()), cut(edges.select("source", "target"))
    if components(vertices, edges).select("component").distinct().limit(2).count() != 1:
        return vertices.sparkSession.createDataFrame([], "id string, closeness double")

    towards = cut(edges.filter("source <> target").select(F.col("target").alias("source"), F.col("source").alias("target")).distinct())
    n = vertices.count()
    told = _in_pieces(vertices, towards, close=True)
    if told is None and _is_small(vertices, towards):
        told = _dealt(vertices, towards, _reached_at_once, "r long, far long")
    if told is None:
        close = _close(vertices, towards)
    else:
        close = [told.filter("r > 0").select("id", (F.col("r") / F.col("far") * F.col("r") / (n - 1)).alias("part"))]
    return _summed(vertices, close, "closeness", 1.0)


def articulation_points(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices whose loss would part their component, without a depth-first search, which can't be dealt over tasks: a breadth-first
    forest is numbered in preorder, level by level; edges of the forest are in one block if an edge outside of it leads around their
    common vertex; the blocks are components of a graph of the forest's edges, and a vertex on two blocks is an articulation point."""
    vertices = cut(vertices.select("id").distinct())
    ids = vertices.select("id")
    e = cut(simple(edges).join(ids.withColumnRenamed("id", "a"), "a", "left_semi").join(ids.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b"))
    sym = e.union(e.select("b", "a"))
    roots = components(ids, e.select(F.col("a").alias("source"), F.col("b").alias("target"))).select("component").distinct()
    levels = [cut(roots.select(F.col("component").alias("v"), F.lit(None).cast("string").alias("p")))]
    while True:
        found = sym.join(levels[-1].select(F.col("v").alias("a")), "a").groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        front = cut(found.join(reduce(DataFrame.unionAll, [x.select("v") for x in levels]), "v", "left_anti"))
        if front.isEmpty():
            break
        levels.append(front)
    # sizes of subtrees from the last level back, then places from the first level on
    sized, below = [], None
    for x in reversed(levels):
        if below is None:
            below = cut(x.withColumn("n", F.lit(1).cast("long")))
        else:
            under = below.groupBy(F.col("p").alias("v")).agg(F.sum("n").alias("under"))
            below = cut(x.join(under, "v", "left").select("v", "p", (1 + F.coalesce("under", F.lit(0))).alias("n")))
        sized.append(below)
    sized.reverse()
    placed = []
    for k, x in enumerate(sized):
        before = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if k:
            x = x.withColumn("before", before).join(placed[-1].select(F.col("v").alias("p"), F.col("pre").alias("up"), "root"), "p").select("v", "p", "n", (F.col("up") + 1 + F.col("before")).alias("pre"), "root")
        else:
            x = x.select("v", "p", "n", F.lit(0).cast("long").alias("pre"), F.col("v").alias("root"))  # places are told within a tree
        placed.append(cut(x))
    tree = cut(reduce(DataFrame.unionAll, placed))
    side = lambda c: tree.select(F.col("v").alias(c), F.col("p").alias(f"p_{c}"), F.col("pre").alias(f"pre_{c}"), F.col("n").alias(f"n_{c}"))
    outside = cut(e.join(side("a"), "a").join(side("b"), "b").filter("not (p_a <=> b) and not (p_b <=> a)"))
    near = outside.select(F.col("a").alias("v"), F.col("pre_b").alias("pre")).union(outside.select("b", "pre_a")).groupBy("v").agg(F.min("pre").alias("least"), F.max("pre").alias("most"))
    told, below = [], None
    for x in reversed(placed):
        own = x.join(near, "v", "left").select("v", "p", "n", "pre", F.least("pre", "least").alias("low"), F.greatest("pre", "most").alias("high"))
        if below is not None:
            under = below.groupBy(F.col("p").alias("v")).agg(F.min("low").alias("l"), F.max("high").alias("h"))
            own = own.join(under, "v", "left").select("v", "p", "n", "pre", F.least("low", "l").alias("low"), F.greatest("high", "h").alias("high"))
        below = cut(own)
        told.append(below)
    # an edge of the forest goes by its lower end v
    lower = reduce(DataFrame.unionAll, told)
    up = tree.filter("p is not null").select(F.col("v").alias("p"), F.col("pre").alias("pre_p"), F.col("n").alias("n_p"))
    around = lower.join(up, "p").filter("low < pre_p or high >= pre_p + n_p").select(F.col("v").alias("source"), F.col("p").alias("target"))
    across = outside.filter("pre_a + n_a <= pre_b or pre_b + n_b <= pre_a").select("a", "b")
    blocks = components(tree.filter("p is not null").select(F.col("v").alias("id")), around.union(across))
    ends = blocks.join(tree.select(F.col("v").alias("id"), "p"), "id").select(F.explode(F.array("id", "p")).alias("id"), "component").distinct()
    return ends.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")


def _ranks_at_once(vertices: DataFrame, edges: DataFrame, rounds: int = 200, alpha: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """pagerank() of a graph of up to PIECED edges, as arrays of numbers in one task. Vertices without edges have one rank."""
    vertices, edges = cut(vertices.select("id").distinct()), cut(edges.select("source", "target"))
    n, (place, packed) = vertices.count(), _numbered(vertices, edges)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        known, a, b = _unpacked(rows)
        out, lone = np.bincount(a, minlength=len(known)), n - len(known)
        rank, single = np.full(len(known), 1 / n), 1 / n
        for _ in range(rounds):
            lost = rank[out == 0].sum() + lone * single
            rest = alpha * lost / n + (1 - alpha) / n
            after = alpha * np.bincount(b, (rank / np.maximum(out, 1))[a], len(known)) + rest
            change = np.abs(after - rank).sum() + lone * abs(rest - single)
            rank, single = after, rest
            if change < tolerance:
                break
        return pa.table({"k": pa.array(np.append(known, -1), pa.int32()), "rank": pa.array(np.append(rank, single))})

    told = cut(_each(packed, 1).applyInArrow(run, "k int, rank double"))
    single = told.filter("k < 0").first()
    return place.join(told, "k", "left").select("id", F.coalesce("rank", F.lit(single["rank"] if single else 1 / max(n, 1))).alias("rank"))


def critical_nodes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices whose degree, betweenness and rank add up to more than a half, twenty at most by name."""
    ranks = pagerank if _is_small(vertices, edges) or edges.count() > PIECED else _ranks_at_once
    rows = degree(vertices, edges).join(betweenness(vertices, edges), "id", "left").join(ranks(vertices, edges), "id")
    score = F.col("centrality") + F.coalesce("betweenness", F.lit(0.0)) + F.col("rank")
    return rows.select("id", score.alias("score")).filter("score > 0.5").orderBy("id").limit(20)


def node_features(hosts: DataFrame, size: int = 64) -> DataFrame:
    """Five hashed features of a host, filled up with zeros: reproducible, unlike a salted hash."""
    share = lambda c: F.conv(F.substring(F.md5(F.coalesce(c, F.lit("unknown"))), 1, 8), 16, 10).cast("long") % 1000 / 1000.0
    own = F.array(share("hostname"), share("environment"), share("datacenter"), share("application"), F.col("confidence"))
    return hosts.select(F.col("hostname").alias("id"), F.slice(F.concat(own, F.array_repeat(F.lit(0.0), size)), 1, size).alias("features"))


def similar(hosts: DataFrame, node: str, top: int = 10) -> DataFrame:
    """Hosts by shared type, environment, datacenter and application, and the cosine of their resources."""
    vector = F.array(F.coalesce("cpu_cores", F.lit(0)).cast("double"), F.coalesce("memory_gb", F.lit(0)).cast("double"), F.col("n_sources").cast("double"))
    rows = hosts.select("hostname", "host_type", "environment", "datacenter", "application", vector.alias("v"))
    one = F.broadcast(rows.filter(F.col("hostname") == node).select(*(F.col(c).alias(f"{c}_n") for c in rows.columns)))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("v", "v_n") / F.sqrt(dot("v", "v") * dot("v_n", "v_n"))
    same = lambda c, w: F.when(F.col(c) == F.col(f"{c}_n"), w).otherwise(0.0)
    score = same("host_type", 0.3) + same("environment", 0.2) + same("datacenter", 0.1) + same("application", 0.2) + cosine * 0.2
    return rows.join(one, rows.hostname != F.col("hostname_n")).select("hostname", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "hostname").limit(top)


def subgraph(edges: DataFrame, kept: DataFrame) -> DataFrame:
    ids = kept.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    d = degree(vertices, edges)
    return d.agg(F.count("*").alias("vertices"), F.avg("degree").alias("average"), F.max("degree").alias("most"), F.min("degree").alias("least"), F.count_if(F.col("degree") == 0).alias("isolated"))


def cytoscape(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """A JSON element a row: nodes and edges."""
    nodes = vertices.select(F.to_json(F.struct(F.lit("nodes").alias("group"), F.struct("id").alias("data"))).alias("element"))
    links = edges.select(F.to_json(F.struct(F.lit("edges").alias("group"), F.struct("source", "target", "type", "confidence").alias("data"))).alias("element"))
    return nodes.union(links)


GRAPHML_HEAD = '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="type" for="edge" attr.name="type" attr.type="string"/><graph edgedefault="directed">'
GRAPHML_FOOT = "</graph></graphml>"


def graphml(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of a GraphML document in order: head, nodes, edges, foot."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    ends = vertices.sparkSession.createDataFrame([(0, GRAPHML_HEAD), (3, GRAPHML_FOOT)], "part int, line string")
    nodes = vertices.select(F.lit(1).alias("part"), F.format_string('<node id="%s"/>', esc(F.col("id"))).alias("line"))
    links = edges.select(F.lit(2), F.format_string('<edge source="%s" target="%s"><data key="type">%s</data></edge>', esc(F.col("source")), esc(F.col("target")), "type"))
    return ends.union(nodes).union(links).orderBy("part").select("line")


def hierarchy(hosts: DataFrame) -> DataFrame:
    """The tree environment, datacenter, application, host as rows level, parent (a path), name and number of hosts below."""
    env, dc, app = F.col("environment"), F.col("datacenter"), F.coalesce("application", F.lit("unknown"))
    levels = [("environment", F.lit(""), env), ("datacenter", env, dc), ("application", F.concat_ws("/", env, dc), app), ("host", F.concat_ws("/", env, dc, app), F.col("hostname"))]
    each = F.explode(F.array(*(F.struct(F.lit(level).alias("level"), up.alias("parent"), name.alias("name")) for level, up, name in levels))).alias("x")
    return hosts.select(each).select("x.*").groupBy("level", "parent", "name").agg(F.count("*").alias("n"))
