"""What the findings of a round were about."""

import itertools
import random

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from hostloom.operators import classify as C
from hostloom.operators import graph as G
from hostloom.operators import index as I
from hostloom.operators import pieces as P
from hostloom.operators import relate as R
from hostloom.operators import walks as W
from hostloom.sources import inventory


def test_every_host_of_a_label_is_linked(spark):
    """Findings 5 to 28: the graph held one link for each two labels, between their smallest hosts."""
    hosts = spark.createDataFrame([(f"{label}.d{k}.com", None) for label in ("web", "web-x") for k in range(3)], "hostname string, ip_address string")
    want = {(f"web.d{a}.com", f"web-x.d{b}.com") for a in range(3) for b in range(3)}
    for edges in (R.hierarchy_pairs(hosts), R.named_edges(hosts)):
        got = edges.filter("via_attribute = 'hostname_hierarchy'").collect()
        assert {(r.source, r.target) for r in got if r.type == "parent_of"} == {(r.target, r.source) for r in got if r.type == "child_of"} == want


def test_searches_in_blocks_are_exact(spark, monkeypatch):
    """Findings 2 to 4: searches joined a row for each source and vertex."""
    for name, size in (("STRIP", 5), ("WIDE", 16), ("SPAN", 2), ("SOURCES", 40)):
        monkeypatch.setattr(G, name, size)
    rng = random.Random(3)
    ids = [f"n{k:02d}" for k in range(90)]
    pairs = {(a, b) for a, b in ((rng.choice(ids), rng.choice(ids)) for _ in range(200)) if a != b} | set(itertools.pairwise(ids[:60])) | {(ids[0], ids[59])}
    near = {x: sorted(b for a, b in pairs if a == x) for x in ids}
    between, close = dict.fromkeys(ids, 0.0), {}
    for s in ids:
        far, paths, order = {s: 0}, {s: 1}, [s]
        for u in order:
            for w in near[u]:
                if w not in far:
                    far[w], paths[w] = far[u] + 1, 0
                    order.append(w)
                paths[w] += paths[u] * (far[w] == far[u] + 1)
        owed = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            owed[u] = sum(paths[u] / paths[w] * (1 + owed[w]) for w in near[u] if far[w] == far[u] + 1)
            between[u] += owed[u] * (u != s)
        r = len(order) - 1
        close[s] = r / sum(far.values()) * r / 89 if r else 0.0
    v, e = spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(sorted(pairs), "source string, target string")
    got = {r.id: r.betweenness for r in G.betweenness(v, e).collect()}
    assert got.keys() == between.keys() and all(abs(got[x] - between[x] / (89 * 88)) < 1e-12 for x in ids)
    got = {r.id: r.closeness for r in G.closeness(v, e.select(F.col("target").alias("source"), F.col("source").alias("target"))).collect()}
    assert got.keys() == close.keys() and all(abs(got[x] - close[x]) < 1e-12 for x in ids)


@pytest.mark.parametrize("small", [0, 1 << 20])
def test_small_graphs_are_searched_without_joins(spark, monkeypatch, small):
    """Findings 2 to 4: searches went by joins of blocks, level by level, however small the graph was."""
    for name, size in (("SMALL", small), ("AT_ONCE", 3), ("FOLLOWED", 7)):
        monkeypatch.setattr(G, name, size)
    monkeypatch.delattr(G, "_searches" if small else "_dealt")
    test_searches_in_blocks_are_exact(spark, monkeypatch)


def test_ranks_are_not_broadcast(spark, monkeypatch):
    """Finding 31: each round sent all ranks through the driver."""
    plans, cut = [], G.cut
    monkeypatch.setattr(G, "SMALL", 1)
    monkeypatch.setattr(G, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "source string, target string")
    G.pagerank(e.select(F.col("target").alias("id")), e, rounds=3).count()
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_rows_of_one_file_are_dealt_over_tasks(spark, monkeypatch):
    """Findings 32, 34, 35, 37, 39 to 42, 44 to 46: a table of one file was exploded and sorted by one task."""
    raw = inventory.host_raw(spark, DATA)
    whole, few = sorted(map(repr, raw.collect())), raw.rdd.getNumPartitions()
    monkeypatch.setattr(inventory, "ROWS", 10)
    raw = inventory.host_raw(spark, DATA)
    assert raw.rdd.getNumPartitions() > max(few, len(whole) // 10 - 1)
    assert sorted(map(repr, raw.collect())) == whole


def test_long_walks_are_learnt_from_in_parts(spark, monkeypatch):
    """Finding 1: all walks were learnt from by one task."""
    groups = [[f"{c}{k}" for k in range(8)] for c in "xy"]
    walked = spark.createDataFrame([(f"{j:03d}", [random.Random(j * 40 + k).choice(groups[j % 2]) for k in range(40)]) for j in range(400)], "walk string, path array<string>")
    asked, learn = [], W.Word2Vec
    monkeypatch.setattr(W, "Word2Vec", lambda **k: asked.append(k["numPartitions"]) or learn(**k))
    W.embeddings(walked, size=8)
    monkeypatch.setattr(W, "WORDS", 4000)
    told = {r.id: np.array(r.vector) for r in W.embeddings(walked, size=8).collect()}
    assert asked == [1, 4] and told.keys() == {x for g in groups for x in g}
    cosine = lambda a, b: told[a] @ told[b] / np.linalg.norm(told[a]) / np.linalg.norm(told[b])
    within = np.mean([cosine(a, b) for g in groups for a, b in itertools.combinations(g, 2)])
    assert within > np.mean([cosine(a, b) for a in groups[0] for b in groups[1]]) + 0.1


def test_pipeline_tells_what_ids_decode_to(spark):
    """Finding 30: the last stage encoded without decoding."""
    import corpus_pipeline
    from hostloom.llm.bpe import bpe_encode

    docs = spark.createDataFrame([(1, "The quick brown fox\n"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.encode(spark, docs, "").collect()}
    assert got == {r.doc_id: r.decoded_sha256 for r in bpe_encode(docs, keep=["doc_id"], digests=True).collect()}


def test_edges_are_sorted_in_small_tasks(spark, monkeypatch):
    """Findings 48 to 50: a task found edges of all families and sorted them, with all sorts of the families' joins in memory at once."""
    plans, cut = [], R.cut
    hosts = spark.createDataFrame([(f"{label}-{k}", f"10.0.0.{k}") for label in ("web", "web-x") for k in range(8)], "hostname string, ip_address string")
    want = sorted(map(repr, R.named_edges(hosts).collect()))
    monkeypatch.setattr(R, "SORTED", 10)
    monkeypatch.setattr(R, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    assert sorted(map(repr, R.named_edges(hosts).collect())) == want
    assert max(p.count("Sort [") for p in plans) <= 4
    assert f", {-(-len(want) // 10)})" in plans[-1].split("hashpartitioning(ka#")[1].split("\n")[0]


def test_vectors_are_dealt_by_their_number(spark, monkeypatch):
    """Findings 33 and 36: as many tasks as the session has partitions packed and searched all vectors, a full list in one."""
    rng = np.random.default_rng(5)
    points = [(k, [float(x) for x in (rng.normal(size=4) * (k % 3 > 0) + 20 * (k % 3))]) for k in range(300)]
    rows = spark.createDataFrame(points, "id long, vector array<double>")
    want = sorted(map(tuple, I.search(I.build(rows, lists=4), rows, k=3, probes=4).collect()))
    plans, cut = [], I.cut
    for name, size in (("TASK", 20), ("QUERIES", 10), ("ROWS", 16)):
        monkeypatch.setattr(I, name, size)
    monkeypatch.setattr(I, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    got = I.search(I.build(rows, lists=4), rows, k=3, probes=4)
    assert sorted(map(tuple, got.collect())) == want
    assert any(", 15)" in p.split("hashpartitioning(list#")[1].split("\n")[0] for p in plans if "hashpartitioning(list#" in p)  # 300 rows
    assert "salt" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 60)" in plan  # 300 queries in four lists


def test_every_value_of_an_attribute_is_kept(spark):
    """Finding 4 of round 4: the first five values were kept, and numbers and dates were left out."""
    from hostloom.plans.all_queries import QUERIES

    columns = [f.name for f in inventory.host_raw(spark, DATA).schema] + ["hostname", "confidence"]
    rows = [dict.fromkeys(columns) | {"table_name": "t", "row_id": k, "hostname": "h-1", "owner": f"team-{9 - k}", "cpu_cores": k, "last_seen": f"2024-01-0{1 + k * 5 % 9}"} for k in range(9)]
    kinds = {"row_id": "long", "cpu_cores": "int", "memory_gb": "int", "confidence": "double"}
    picked = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
    got = {r.attribute: r.value for r in C.reduce_attributes(picked, {"last_seen": "timestamp", "cpu_cores": "numeric"}).collect()}
    assert got["owner"] == ",".join(f"team-{9 - k}" for k in range(9)) and got["cpu_cores"] == "4.0" and got["last_seen"] == "2024-01-09"
    held = {r.attribute for r in QUERIES["n2_reduced_attributes"](spark, DATA).select("attribute").distinct().collect()}
    assert {"owner", "cpu_cores", "memory_gb", "last_seen"} <= held


def hubs_and_pieces(seed, groups, shapes, size, hubs):
    """Ends of edges: hubs linked both ways with many vertices of pieces whose shapes repeat."""
    rng = random.Random(seed)
    made = [({(a, b) for a, b in ((rng.randrange(size), rng.randrange(size)) for _ in range(2 * size)) if a != b}, [(rng.randrange(hubs), v) for v in range(size)], [(v, rng.randrange(hubs)) for v in range(0, size, 2)]) for _ in range(shapes)]
    arcs = {(0, hubs - 1)} if hubs > 1 else set()
    for g in range(groups):
        at, (inside, led, leave) = hubs + g * size, made[g % shapes]
        arcs |= {(at + a, at + b) for a, b in inside} | {(h, at + v) for h, v in led} | {(at + v, h) for v, h in leave}
    return np.array(sorted(arcs)).T


@pytest.mark.parametrize("seed", range(12))
def test_searches_within_pieces_are_exact(monkeypatch, seed):
    """Findings 1 to 3 of round 4: every search went through the whole graph."""
    for name, sizes in (("JOINED", (1, 5, 96)), ("MATRIX", (2, 1024)), ("COLUMNS", (3, 256)), ("CELLS", (1, 1 << 20))):
        monkeypatch.setattr(P, name, sizes[seed % len(sizes)])
    a, b = hubs_and_pieces(seed, groups=9, shapes=4, size=1 + seed % 6, hubs=1 + seed % 4)
    n, q = int(max(a.max(), b.max())) + 1, seed % 4 + (seed % 3 > 0)  # all hubs, or one is taken for a vertex of a piece
    want, told = np.zeros(n), G._owed_at_once(a, b, n, np.arange(n))
    want[told["k"]] = told["part"]
    g = P.Pieces(a, b, n, np.arange(q))
    parts = [g.owed(k, 3) for k in range(3)]
    assert np.allclose(sum(x[0] for x in parts) + g.across(sum(x[1] for x in parts)), want, rtol=1e-12, atol=1e-9)
    parts = [P.Pieces(a, b, n, np.arange(q), counted=False).reached(k, 3) for k in range(3)]
    source, r, far = (np.concatenate(x) for x in zip(*parts, strict=True))
    told = G._reached_at_once(a, b, n, np.arange(n))
    assert sorted(source) == list(range(n)) and (r == told["r"][source]).all() and (far == told["far"][source]).all()


def test_betweenness_of_a_graph_in_pieces(spark, monkeypatch):
    """Finding 1 of round 4."""
    a, b = hubs_and_pieces(1, groups=90, shapes=2, size=5, hubs=3)
    n = int(max(a.max(), b.max())) + 1
    told = G._owed_at_once(a, b, n, np.arange(n))
    want = dict(zip((f"v{k}" for k in told["k"]), told["part"] / ((n - 1) * (n - 2)), strict=True))
    for name in ("_dealt", "_searches"):
        monkeypatch.delattr(G, name)
    v, e = spark.createDataFrame([(f"v{k}",) for k in range(n)], "id string"), spark.createDataFrame([(f"v{x}", f"v{y}") for x, y in zip(a, b, strict=True)], "source string, target string")
    monkeypatch.setattr(G, "WORTH", 500)
    got = {r.id: r.betweenness for r in G.betweenness(v, e).collect()}
    assert len(got) == n and max(got.values()) > 0 and all(abs(got[x] - want.get(x, 0.0)) < 1e-12 for x in got)


def test_closeness_of_a_graph_in_pieces(spark, monkeypatch):
    """Finding 3 of round 4."""
    a, b = hubs_and_pieces(2, groups=90, shapes=2, size=5, hubs=3)
    n = int(max(a.max(), b.max())) + 1
    told = G._reached_at_once(b, a, n, np.arange(60))
    for name in ("_dealt", "_searches"):
        monkeypatch.delattr(G, name)
    v, e = spark.createDataFrame([(f"v{k}",) for k in range(n)], "id string"), spark.createDataFrame([(f"v{x}", f"v{y}") for x, y in zip(a, b, strict=True)], "source string, target string")
    monkeypatch.setattr(G, "WORTH", 500)
    got = {r.id: r.closeness for r in G.closeness(v, e).collect()}
    want = {f"v{k}": r / far * r / (n - 1) if r else 0.0 for k, r, far in zip(told["k"], told["r"], told["far"], strict=True)}
    assert len(got) == n and max(want.values()) > 0 and all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_ranks_of_large_graphs_as_arrays(spark, monkeypatch):
    """Finding 2 of round 4: ranks of a graph of over SMALL edges were found by joins, round after round."""
    v = spark.createDataFrame([(x,) for x in "abcdefz"], "id string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("b", "c"), ("c", "a"), ("c", "d"), ("e", "f"), ("d", "d")], "source string, target string")
    want = {r.id: r["rank"] for r in G.pagerank(v, e).collect()}
    score = {r.id: r.score for r in G.critical_nodes(v, e).collect()}
    got = {r.id: r["rank"] for r in G._ranks_at_once(v, e).collect()}
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)
    monkeypatch.setattr(G, "SMALL", 1)
    monkeypatch.setattr(G, "pagerank", None)
    large = {r.id: r.score for r in G.critical_nodes(v, e).collect()}
    assert large.keys() == score.keys() and score and all(abs(large[x] - score[x]) < 1e-9 for x in score)
