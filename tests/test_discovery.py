"""Discovery over catalogs, samples, types of columns, the index of vectors, walks, and measures of graphs of any size."""

import itertools
import math
import random

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from hostloom.operators import catalog as C
from hostloom.operators import graph as G
from hostloom.operators import index as I
from hostloom.operators import relate as R
from hostloom.operators import sample as B
from hostloom.operators import types as M
from hostloom.operators import walks as W
from hostloom.operators.resolve import nearest
from hostloom.plans import type_queries


# Catalogs


@pytest.fixture(scope="module")
def unlike(spark, tmp_path_factory):
    """Tables of unlike schemas, one of them told by its values alone, one without hosts, one empty."""
    folder = tmp_path_factory.mktemp("catalog")
    tables = {
        "vm": ("instance_name string, node string, private_ip string, env string, `odd.name` int, tags array<string>", [("Web-1", "n1", "10.0.0.1", "PROD", 1, ["a"]), ("bad name", "db-2", None, "", None, None), (None, "-", "10.0.0.9", "dev", 3, []), (None, None, "10.0.0.999", "dev", 4, None)]),
        "seen": ("k long, what string, hostname string, table_name string", [(1, "web-1.x.org", None, "t"), (2, "cache-2.x.org", None, "t"), (3, None, None, "t"), (4, "", "", "u")]),
        "nothing": ("a int, b string", [(1, "10.1"), (2, "two words")]),
        "empty": ("server_name string, ip_address string", []),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    (folder / "readme.txt").write_text("no table")
    return str(folder)


def test_tables_of_a_folder(spark, unlike):
    assert list(C.tables(spark, unlike)) == ["empty", "nothing", "seen", "vm"]
    assert list(C.tables(spark, unlike, "(vm|seen)", "se.*")) == ["vm"]


def test_columns_are_found_by_names_and_values(spark, unlike):
    found = {(r.table_name, r.column_name, r.category): round(r.confidence, 6) for r in C.found(C.tables(spark, unlike)).collect()}
    assert found[("vm", "instance_name", "hostname")] == 1.0 and found[("vm", "node", "hostname")] == 0.7
    assert found[("vm", "private_ip", "ip")] == 0.9 and found[("vm", "env", "environment")] == 0.9
    assert found[("seen", "what", "hostname")] == 1.1 and not any(t == "nothing" for t, *_ in found)
    assert found[("empty", "server_name", "hostname")] == 0.9


def test_rows_of_unlike_tables_come_out_alike(spark, unlike):
    rows = C.host_rows(C.tables(spark, unlike))
    got = {r.hostname: (r.table_name, round(r.confidence, 6), {(a.attribute, a.value) for a in r.attributes}) for r in rows.collect()}
    assert set(got) == {"web-1", "db-2", "10.0.0.9", "web-1.x.org", "cache-2.x.org"}
    assert got["web-1"] == ("vm", 1.0, {("ip_address", "10.0.0.1"), ("environment", "prod"), ("odd.name", "1"), ("tags", '["a"]')})
    assert got["db-2"] == ("vm", 0.7, set()) and got["10.0.0.9"][1] == round(0.9 * 0.7, 6)
    assert got["web-1.x.org"][2] == {("k", "1"), ("table_name", "t")}
    assert {r.hostname: (r.n_sources, r.n_tables) for r in C.hosts(rows.union(rows)).collect()} == dict.fromkeys(got, (2, 1))
    first = {r.host_name: (r.ip_address, r.environment) for r in C.inventory_rows(rows).collect()}
    assert first["web-1"] == ("10.0.0.1", "prod") and first["db-2"] == (None, None)
    assert C.host_rows({"nothing": C.tables(spark, unlike)["nothing"]}).count() == 0


# Samples


def test_sample_is_spread_over_the_table(spark):
    rows = spark.range(50_000).repartition(7).withColumn("x", F.lit("same"))
    got = [r.id for r in B.sampled(rows, 10, 100_000, seed=1).collect()]
    assert len(got) == len(set(got)) == 5000
    share = np.bincount(np.array(got) // 5000, minlength=10)
    assert share.min() > 400 and share.max() < 600
    assert sorted(got) == sorted(r.id for r in B.sampled(rows.coalesce(1).orderBy(F.desc("id")), 10, 100_000, seed=1).collect())
    assert sorted(got) != sorted(r.id for r in B.sampled(rows, 10, 100_000, seed=2).collect())


def test_sample_of_equal_rows_has_its_size(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("own")).repartition(5)
    for n in (0, 1, 500, 1999, 2000, 2500, 3000, 4000):
        got = B.smallest(rows, n, by=["k"]).collect()
        assert len(got) == min(n, 3000) == len({r.own for r in got})
    assert B.sampled(rows.filter("false"), 10, 5) is None


def test_blocks_are_whole_and_only_chosen_ones_are_read(spark, tmp_path):
    spark.range(60_000).repartitionByRange(12, "id").withColumn("t", F.timestamp_seconds("id")).write.option("parquet.block.row.count.limit", 1000).option("parquet.block.size", 1 << 14).parquet(str(tmp_path / "t"))
    blocks = B.blocks(spark, str(tmp_path / "t"))
    assert blocks.agg(F.sum("n_rows")).first()[0] == 60_000 and blocks.count() >= 12
    got = B.block_sample(spark, str(tmp_path / "t"), 40, seed=3)
    ids = {r.id for r in got.collect()}
    assert 0 < len(ids) < 60_000 and got.schema == spark.read.parquet(str(tmp_path / "t")).schema
    assert ids == {r.id for r in B.block_sample(spark, str(tmp_path / "t"), 40, seed=3).collect()}
    assert B.block_sample(spark, str(tmp_path / "t"), 100).count() == 60_000 and B.block_sample(spark, str(tmp_path / "t"), 0).count() == 0


# Types


def test_types_of_held_out_slices_and_columns(spark):
    rows, known, model = type_queries.trained(spark, DATA)
    held = M.labelled(M.predicted(model, known.filter("slice % 5 = 0").drop("type"), type_queries.TYPES).withColumnRenamed("type", "told"), type_queries.LABELS).collect()
    assert len(held) >= 45 and sum(r.told == r.type for r in held) / len(held) > 0.9
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 and r.confidence == max(r.probabilities) for r in held)
    away = {("dns_records", "ipv4"), ("flows", "seen_at"), ("assets", "cost"), ("orders", "o_orderdate"), ("conversations", "text"), ("customer", "c_name")}
    gone = F.concat_ws(".", "table_name", "column_name").isin([".".join(x) for x in away])
    other = M.train(known.filter(~gone), type_queries.TYPES)
    got = {(r.table_name, r.column_name): r.type for r in M.predicted(other, known.filter(gone).drop("type"), type_queries.TYPES).collect()}
    assert sum(type_queries.LABELS[t][c] == kind for (t, c), kind in got.items()) >= 5
    again = {(r.table_name, r.column_name): r.probabilities for r in M.predicted(M.train(known.filter("slice % 5 <> 0").repartition(3), type_queries.TYPES), rows, type_queries.TYPES).collect()}
    first = {(r.table_name, r.column_name): r.probabilities for r in M.predicted(model, rows, type_queries.TYPES).collect()}
    assert max(abs(a - b) for k in first for a, b in zip(first[k], again[k], strict=True)) < 1e-3


def test_decoding_equals_all_sequences(spark):
    r, n = random.Random(4), 3
    steps = [[r.uniform(-3, 0) for _ in range(n)] for _ in range(n)]
    tables = {f"t{size}": [[r.uniform(-3, 0) for _ in range(n)] for _ in range(size)] for size in (1, 2, 5, 6)}
    rows = [(t, k, e) for t, es in tables.items() for k, e in enumerate(es)]
    got = {x.table_name: (x.score, list(x.labels)) for x in M.decoded(spark.createDataFrame(rows, "table_name string, ordinal int, e array<double>").repartition(3), steps).collect()}
    for t, es in tables.items():
        best = max((sum(e[j] for e, j in zip(es, path, strict=True)) + sum(steps[i][j] for i, j in itertools.pairwise(path)), list(path)) for path in itertools.product(range(n), repeat=len(es)))
        assert got[t][1] == best[1] and abs(got[t][0] - best[0]) < 1e-9
    told = M.transitions(spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 2), ("b", 0, 1)], "table_name string, ordinal int, label int"), 3)
    assert [[round(math.exp(x), 6) for x in line] for line in told] == [[round(1 / 3, 6)] * 3, [0.25, 0.25, 0.5], [0.25, 0.25, 0.5]]


def plain_label_model(votes, classes, rounds):
    items, right = {}, {}
    for item, voter, vote in votes:
        items.setdefault(item, []).append((voter, vote))
        right[voter] = 0.8

    def posterior(own):
        weight = {c: math.prod(right[v] if x == c else (1 - right[v]) / (classes - 1) for v, x in own) for _, c in own}
        total = sum(weight.values()) + (classes - len(weight)) * math.prod((1 - right[v]) / (classes - 1) for v, _ in own)
        return {c: w / total for c, w in weight.items()}

    for _ in range(rounds):
        sums = dict.fromkeys(right, (1.0, 2))
        for own in items.values():
            p = posterior(own)
            for v, x in own:
                sums[v] = sums[v][0] + p[x], sums[v][1] + 1
        right = {v: s / n for v, (s, n) in sums.items()}
    return {i: max((round(p, 9), c) for c, p in posterior(own).items()) for i, own in items.items()}, right


def test_label_model_equals_a_plain_loop_and_tells_good_voters(spark):
    r = random.Random(8)
    accuracy = {"good": 0.95, "fair": 0.75, "poor": 0.3, "lone": 0.9}
    truth = {f"i{k}": r.randrange(5) for k in range(300)}
    votes = [(i, v, str(t if r.random() < a else (t + r.randrange(1, 5)) % 5)) for i, t in truth.items() for v, a in accuracy.items() if r.random() < 0.7]
    frame = spark.createDataFrame([*votes, ("none", None, "1"), ("none", "good", None)], "item string, voter string, vote string").repartition(4)
    told, right = M.label_model(frame, 5, rounds=7, tolerance=0)
    expected, accuracies = plain_label_model(votes, 5, 7)
    got = {x.item: (round(x.confidence, 6), x.label) for x in told.collect()}
    assert got == {i: (round(p, 6), c) for i, (p, c) in expected.items()}
    assert all(abs(right[v] - a) < 1e-9 for v, a in accuracies.items())
    told, right = M.label_model(frame, 5)
    assert all(abs(right[v] - a) < 0.1 for v, a in accuracy.items())
    assert sum(int(x.label) == truth[x.item] for x in told.collect()) / len(expected) > 0.85
    assert M.label_model(frame.filter("false"), 5)[0].isEmpty()


def test_a_failing_column_becomes_unknown(spark):
    values = spark.createDataFrame([("t", c, v) for c, v in (("a", "1"), ("b", "x"), ("c", "2"), ("d", "3"))], "table_name string, column_name string, value string")
    classify = lambda v: v.groupBy("table_name", "column_name").agg(F.lit("number").alias("type"), F.max(F.col("value").cast("int") / 3).alias("confidence"))  # noqa: E731  fails on b
    assert sorted(tuple(r) for r in M.safely(values, classify).collect()) == [("t", "a", "number", 1 / 3), ("t", "b", "unknown", 0.0), ("t", "c", "number", 2 / 3), ("t", "d", "number", 1.0)]
    assert M.safely(values.filter("false"), classify).isEmpty()


# The index


def test_index_has_recall(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16)) * 4
    vectors = np.concatenate([centers[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)), np.repeat(centers[:1], 2000, 0) + rng.normal(size=(2000, 16)) / 50])  # a third in one place
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "id long, vector array<double>").repartition(6)
    queries = rows.filter("id % 20 = 0")
    index = I.build(rows)
    found, exact = I.search(index, queries, probes=6).cache(), nearest(rows, queries).cache()
    assert I.recall(found, exact) >= 0.9 and found.groupBy("query").count().filter("count <> 10").isEmpty()
    assert index.blocks.agg(F.sum(F.size("ids")), F.max(F.size("ids"))).first()[0] == 6000 and index.blocks.agg(F.max(F.size("ids"))).first()[0] < 2 * I.ROWS
    every = I.search(index, queries, probes=len(index.centers))
    assert sorted((r.query, r["rank"], r.neighbour) for r in every.collect()) == sorted((r.query, r["rank"], r.neighbour) for r in exact.collect())


def test_index_of_little(spark):
    rows = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [0.0, 1.0]), ("c", [5.0, 1.0]), ("n", None)], "id string, vector array<double>")
    found = I.search(I.build(rows), rows, k=1).collect()
    assert sorted((r.query, r.neighbour, r.distance) for r in found) == [("a", "b", 0.0), ("b", "a", 0.0), ("c", "a", 5.0)]
    assert I.search(I.build(rows.filter("false")), rows).isEmpty()
    pairs = spark.createDataFrame([("a", "b"), ("a", "z")], "a string, b string")
    assert {tuple(r) for r in I.candidates(I.search(I.build(rows), rows, k=1), pairs).collect()} == {("a", "b"), ("a", "z"), ("a", "c")}


# Walks


def test_walks_equal_a_plain_walker_on_any_partitioning(spark):
    import hashlib

    r = random.Random(5)
    ids = [f"v{k}" for k in range(30)]
    edges = [(r.choice(ids[:-1]), r.choice(ids[:-1])) for _ in range(50)] + [("v0", v) for v in ids[1:-1]]
    digest = lambda *x: int(hashlib.md5("|".join(map(str, x)).encode()).hexdigest()[:8], 16)  # noqa: E731, S324
    near = {v: sorted({b for a, b in edges + [(b, a) for a, b in edges] if a == v and b != v}, key=lambda b: (hashlib.md5(b.encode()).hexdigest()[0], b)) for v in ids}  # noqa: S324
    expected = {}
    for v in ids:
        for j in range(2):
            path, walk = [v], f"{v}#{j}"
            for k in range(5):
                if near[path[-1]]:
                    path.append(near[path[-1]][digest(42, walk, k) % len(near[path[-1]])])
            expected[walk] = path
    for parts in (1, 5):
        v = spark.createDataFrame([(x,) for x in ids], "id string").repartition(parts)
        e = spark.createDataFrame(edges, "source string, target string").repartition(parts)
        assert {x.walk: list(x.path) for x in W.walks(v, e, each=2, length=6).collect()} == expected
    assert len(expected["v29#0"]) == 1


def test_embeddings_know_communities(spark):
    edges = [(f"{c}{a}", f"{c}{b}") for c in "xy" for a, b in itertools.combinations(range(8), 2)] + [("x0", "y0")]
    v = spark.createDataFrame(sorted({(x,) for e in edges for x in e}), "id string")
    told = {r.id: np.array(r.vector) for r in W.embeddings(W.walks(v, spark.createDataFrame(edges, "source string, target string"), each=20, length=12), size=16).collect()}
    cosine = lambda a, b: told[a] @ told[b] / np.linalg.norm(told[a]) / np.linalg.norm(told[b])
    within = np.mean([cosine(f"{c}{a}", f"{c}{b}") for c in "xy" for a, b in itertools.combinations(range(1, 8), 2)])
    assert within > np.mean([cosine(f"x{a}", f"y{b}") for a in range(1, 8) for b in range(1, 8)]) + 0.1


# Graphs


def test_searches_in_parts_give_the_same(spark, monkeypatch):
    """Sources are searched from a few at a time where they are many."""
    r = random.Random(1)
    ids = [f"v{k:02}" for k in range(18)]
    edges = sorted({(r.choice(ids), r.choice(ids)) for _ in range(26)})
    v, e = spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(edges, "source string, target string")
    table = lambda df: {x[0]: round(x[1], 9) for x in df.collect()}
    whole = table(G.betweenness(v, e))
    monkeypatch.setattr(G, "SOURCES", 7)
    assert table(G.betweenness(v, e)) == whole and max(whole.values()) > 0


def test_a_hub_forms_no_wedges(spark):
    import time

    star = spark.range(12_000).select(F.lit("a").alias("source"), F.format_string("n%05d", "id").alias("target"))
    extra = spark.createDataFrame([("n00001", "n00002")], "source string, target string")
    e = star.union(extra)
    began = time.time()
    got = {r.id: r.clustering for r in G.clustering(e.select(F.col("target").alias("id")).distinct().union(star.select("source").distinct()), e).filter("clustering > 0").collect()}
    assert got["n00001"] == got["n00002"] == 1 and abs(got["a"] - 2 / (12_000 * 11_999)) < 1e-15 and time.time() - began < 30


def test_hosts_of_one_label_are_a_class(spark):
    hosts = spark.range(4000).select(F.when(F.col("id") < 2000, F.format_string("srv.d%d.com", "id")).otherwise(F.format_string("srv-1.d%d.com", "id")).alias("hostname"))
    got = R.hierarchy(hosts).collect()
    assert {(r.source, r.target, r.type, r.links) for r in got} == {("srv.d0.com", "srv-1.d2000.com", "parent_of", 4_000_000), ("srv-1.d2000.com", "srv.d0.com", "child_of", 4_000_000)}
    assert R.label_classes(hosts).groupBy("first").count().count() == 2
    members = R.member_edges(hosts.selectExpr("hostname", "'e' AS environment", "'d' AS datacenter", "hostname AS application"), R.hierarchy(hosts))
    assert members.count() == 3998
