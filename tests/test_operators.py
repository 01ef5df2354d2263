"""Small cases whose results were worked out by hand, and properties of what SQL can't express."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from hostloom.functions import host as H
from hostloom.operators import discovery as D
from hostloom.operators import graph as G
from hostloom.operators import profile as P
from hostloom.operators import quality as Q
from hostloom.operators import relate as R
from hostloom.operators import resolve as E
from hostloom.operators import scan as S
from hostloom.sources import files, sinks


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_hostname_validity(spark):
    assert column(spark, ["web-01", "-bad", "a..b", "WEB.x", None, ""], H.valid_hostname) == [True, False, False, True, False, False]


def test_address_validity(spark):
    assert column(spark, ["10.0.0.1", "999.1.1.1", "1:2:3:4:5:6:7:8", "::1", None], H.valid_ip) == [True, False, True, False, False]
    assert column(spark, [" 1.2.3.4", "1.2.3", "a.b.c.d", "+1.2.3.4"], H.four_octets) == [True, False, False, True]


def test_attribute_types(spark):
    assert column(spark, ["123", "01", "2024-01-01", "yes", "abc"], H.attribute_type) == ["json", "numeric", "date", "boolean", "text"]


def test_column_confidence(spark):
    names = ["hostname", "node_id", "descr", "address", "ip_addr", "l_shipdate"]
    assert column(spark, names, lambda c: D.column_confidence(c, "hostname"))[:3] == [0.95, 0.6, None]
    assert column(spark, names, lambda c: D.column_confidence(c, "ip"))[3:] == [0.5, 0.95, 0.7]


def test_datacenter(spark):
    assert column(spark, ["10.49.0.1", "10.149.0.1", "10.150.0.1", None], lambda ip: H.datacenter(F.lit("x"), ip)) == ["us-east-1", "eu-west-1", "unknown", "unknown"]


def test_timeliness(spark):
    got = column(spark, ["2024-01-30T12:00:00", "2024-01-30T12:00:00Z", None, "", "2023-01-01T00:00:00"], lambda c: Q.timeliness(c, "2024-01-31 00:00:00"))
    assert got == [1.0, 0.5, 0.3, 0.3, 0.2]


def test_cluster_needs_small_gaps(spark):
    hosts = spark.createDataFrame([("n1",), ("n2",), ("n40",), ("m1",), ("m2",)], "hostname string")
    assert {(r.source, r.target) for r in R.clusters(hosts).collect()} == {("m1", "m2")}


def test_hierarchy(spark):
    hosts = spark.createDataFrame([("web",), ("web-01.x.com",), ("webby",)], "hostname string")
    assert {(r.source, r.target, r.type) for r in R.hierarchy(hosts).collect()} == {("web", "web-01.x.com", "parent_of"), ("web-01.x.com", "web", "child_of")}


def test_deduplication_keeps_the_most_confident(spark):
    rows = [("a", "b", "same_network", 0.7, "x"), ("b", "a", "same_network", 0.9, "x"), ("a", "b", "parent_of", 0.7, "x"), ("b", "a", "parent_of", 0.7, "x")]
    edges = spark.createDataFrame(rows, "source string, target string, type string, confidence double, via_attribute string")
    got = R.deduplicate(edges).collect()
    assert sorted((r.source, r.target, r.type, r.confidence) for r in got) == [("a", "b", "parent_of", 0.7), ("b", "a", "parent_of", 0.7), ("b", "a", "same_network", 0.9)]


def test_rule_types(spark):
    rows = [("t", "host", i, v) for i, v in enumerate(["10.0.0.1", "10.0.0.2"])] + [("t", "k", i, v) for i, v in enumerate(["1", "22", "333"])] + [("t", "empty", 0, None)]
    got = {r.column_name: (r.type, r.confidence) for r in P.rule_types(spark.createDataFrame(rows, "table_name string, column_name string, place long, value string")).collect()}
    assert got == {"host": ("ip_address", 0.95), "k": ("hostname", 0.9)}


def test_ensemble(spark):
    rows = [("c", "sherlock", "hostname", 0.8), ("c", "doduo", "ip_address", 0.6)]
    got = P.ensemble(spark.createDataFrame(rows, "column_name string, model string, type string, confidence double")).first()
    assert (got.type, got.confidence) == ("ip_address", 0.21)


def test_ratio_is_that_of_the_sorted_pair(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("a", "A"), ("web-01", "web-01.corp"), (None, "x")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in rows.select("i", E.ratcliff("a", "b").alias("r")).orderBy("i").select("r").collect()]
    assert got[0] == got[1] == SequenceMatcher(None, "diet", "tide").ratio()
    assert got[2:] == [1.0, SequenceMatcher(None, "web-01", "web-01.corp").ratio(), None]


def test_match_is_greedy_by_similarity(spark):
    rows = [("a", "b", 0.9), ("b", "c", 0.95), ("c", "d", 0.91), ("a", "d", 0.85), ("e", "f", 0.7)]
    got = E.match(spark.createDataFrame(rows, "a string, b string, similarity double")).collect()
    assert {(r.a, r.b) for r in got} == {("b", "c"), ("a", "d")}


def test_master(spark):
    got = E.masters(spark.createDataFrame([("web01", "web01.corp")], "a string, b string")).first()
    assert got.master == "web01.corp"


@pytest.fixture(scope="module")
def path_graph(spark):
    v = spark.createDataFrame([(x,) for x in "abcdez"], "id string")
    e = spark.createDataFrame([("a", "b", "t", 1.0), ("b", "c", "t", 1.0), ("c", "d", "t", 1.0), ("b", "e", "t", 1.0)], "source string, target string, type string, confidence double")
    return v, e


def test_graph(spark, path_graph):
    v, e = path_graph
    assert {r.id: r.component for r in G.components(v, e).collect()} == {**dict.fromkeys("abcde", "a"), "z": "z"}
    assert {r.id: r.hops for r in G.reach(e, "a").collect()} == {"b": 1, "c": 2, "d": 3, "e": 2}
    assert G.shortest_path(e, "a", "d").first().path == ["a", "b", "c", "d"]
    assert G.shortest_path(e, "d", "a").count() == 0
    assert {r.id for r in G.articulation_points(v, e).collect()} == {"b", "c"}
    between = {r.id: round(r.betweenness * 20, 6) for r in G.betweenness(v, e).collect()}
    assert between == {"a": 0, "b": 3, "c": 2, "d": 0, "e": 0, "z": 0}
    assert abs(sum(r["rank"] for r in G.pagerank(v, e).collect()) - 1) < 1e-9


def test_rank_by_arrays_is_that_by_joins(spark, path_graph, monkeypatch):
    v, e = path_graph
    e = e.union(e.filter("source = 'b'")).union(spark.createDataFrame([("d", "a", "t", 1.0)], e.schema))
    arrays = {r.id: r["rank"] for r in G.pagerank(v, e).collect()}
    monkeypatch.setattr(G, "SMALL", 1)
    joins = {r.id: r["rank"] for r in G.pagerank(v, e, tolerance=1e-6).collect()}
    assert arrays.keys() == joins.keys() and all(abs(arrays[k] - joins[k]) < 1e-5 for k in arrays)


def test_closeness_of_connected_graphs_only(spark, path_graph):
    v, e = path_graph
    assert G.closeness(v, e).count() == 0
    got = {r.id: round(r.closeness, 9) for r in G.closeness(v.filter("id <> 'z'"), e).collect()}
    assert got == {"a": 0, "b": 0.25, "c": round(2 / 3 * 2 / 4, 9), "d": 0.375, "e": round(2 / 3 * 2 / 4, 9)}


def test_betweenness_and_cut_vertices_of_random_graphs(spark):
    import itertools
    import random

    r = random.Random(3)
    ids = [f"v{k:02}" for k in range(14)]
    ends = sorted({tuple(r.sample(ids, 2)) for _ in range(24)})
    v = spark.createDataFrame([(x,) for x in ids], "id string")
    e = spark.createDataFrame([(*p, "t", 1.0) for p in ends], "source string, target string, type string, confidence double")
    out = {x: [b for a, b in ends if a == x] for x in ids}

    def paths(s, t):
        front = [[s]]
        while front:
            if found := [p for p in front if p[-1] == t]:
                return found
            front = [[*p, w] for p in front for w in out[p[-1]] if w not in p]
        return []

    want = dict.fromkeys(ids, 0.0)
    for s, t in itertools.permutations(ids, 2):
        every = paths(s, t)
        for p in every:
            for x in p[1:-1]:
                want[x] += 1 / len(every)
    got = {x.id: x.betweenness for x in G.betweenness(v, e).collect()}
    assert all(abs(got[x] - want[x] / (13 * 12)) < 1e-12 for x in ids)

    def parts(without):
        left = [x for x in ids if x != without]
        n = 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                x = todo.pop()
                for y in [b for a, b in ends if a == x] + [a for a, b in ends if b == x]:
                    if y in left:
                        left.remove(y)
                        todo.append(y)
        return n

    alone = {x for x in ids if not any(x in p for p in ends)}
    assert {x.id for x in G.articulation_points(v, e).collect()} == {x for x in ids if x not in alone and parts(x) > parts(None)}
    found = {(x.start, x.end): x.path for x in G.shortest_paths(e, [(a, b) for a in ids[:4] for b in ids[4:]]).collect()}
    for a in ids[:4]:
        for b in ids[4:]:
            every = paths(a, b)
            assert found.get((a, b)) == (min(every) if every else None)


def test_places_count_every_pair_once(spark):
    import random

    r = random.Random(5)
    rows = [(f"h{k}", r.choice(["production", "testing", "unknown"]), r.choice(["dc1", "dc2", "unknown"]), r.choice(["web", "unknown", None])) for k in range(40)]
    got = {x.hostname: (x.same_application, x.same_environment, x.same_datacenter) for x in R.same_place(spark.createDataFrame(rows, "hostname string, environment string, datacenter string, application string")).collect()}
    for h, env, dc, app in rows:
        kinds = [0, 0, 0]
        for h2, env2, dc2, app2 in rows:
            if h2 == h:
                continue
            if env == env2 != "unknown":
                kinds[0 if app == app2 != "unknown" else 1] += 1
            elif dc == dc2 != "unknown":
                kinds[2] += 1
        assert got[h] == tuple(kinds)


def test_match_ends_only_when_nothing_is_left(spark):
    chain = [(f"n{k:03}", f"n{k + 1:03}", 0.81 + k / 1000) for k in range(12)]
    got = E.match(spark.createDataFrame(chain, "a string, b string, similarity double")).collect()
    assert len(got) == 6 and E.match(spark.createDataFrame([], "a string, b string, similarity double")).count() == 0


def test_relations_of_columns(spark):
    col = lambda *v: spark.createDataFrame([(x,) for x in v], "v string")
    assert [P.relation(a, b).first().relation for a, b in ((col("1", "2", None), col("2", "1")), (col("1"), col("1", "2")), (col("1", "2"), col("1")), (col("1"), col("2")))] == ["same_entity", "foreign_key", "hierarchical", "none"]


def test_bad_files_are_skipped_and_loads_are_kept(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "good"))
    (tmp_path / "bad.parquet").write_text("no parquet")
    paths = [str(tmp_path / "good"), str(tmp_path / "bad.parquet")]
    assert S.load(spark, paths, skip_corrupt=True).count() == 5
    with pytest.raises(ValueError):
        S.load(spark, paths[1:], skip_corrupt=True)
    cache, asked = S.LoadCache(most=1), []
    for key in ("a", "a", "b", "a"):
        cache.get(key, lambda key=key: asked.append(key) or spark.read.parquet(paths[0]))
    assert asked == ["a", "b", "a"]


def test_sample_has_its_size(spark):
    assert S.sampled(spark.range(5000), 10, 100_000, 1).count() == 500 and S.sampled(spark.range(5000), 10, 7, 1).count() == 7
    assert S.sampled(spark.range(55), 10, 100).count() == 5 and S.sampled(spark.range(9), 10, 100) is None


def test_limits(spark):
    rows = [("Web-1", "8.8.8.8", 200, 5000, "2019-01-01T00:00:00"), ("web-1", "10.0.0.1", 2, 4, None), ("db", None, None, None, "2024-01-01T00:00:00")]
    got = Q.out_of_limits(spark.createDataFrame(rows, "hostname string, ip_address string, cpu_cores int, memory_gb int, last_seen string"), "2024-01-31 00:00:00").collect()
    assert sorted((r.hostname, r.rule) for r in got) == [("Web-1", r) for r in ("age", "cpu_cores", "ip_range", "memory_gb", "naming_convention")]


def test_scan_ladder(spark):
    def broken():
        raise OSError("gone")

    def none():
        return None

    def works():
        return spark.range(3)

    frame, name = S.scan([broken, none, works])
    assert name == "works" and frame.count() == 3
    assert S.scan([broken]) == (None, "failed")


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", True, ["x"]), ("b", False, [])], "hostname string, is_active boolean, tags array<string>")
    sinks.store({"entities": df}, str(tmp_path / "s"))
    assert [r.hostname for r in sinks.load(spark, str(tmp_path / "s"), ["entities"])["entities"].collect()] == ["a"]
    for form in ("parquet", "json", "csv"):
        sinks.export(df, str(tmp_path / form), form)
    assert files.read_csv(spark, str(tmp_path / "csv"), "hostname string, is_active boolean, tags string").count() == 2
    assert files.read_json(spark, str(tmp_path / "json"), "hostname string").count() == 2
    assert sinks.load_stage(spark, str(tmp_path), "one") is None
    assert sinks.save_stage(df, str(tmp_path), "one").count() == sinks.load_stage(spark, str(tmp_path), "one").count() == 2


def test_streams(spark, tmp_path):
    from compare import DATA

    from hostloom.streaming import discover

    q = discover.windowed(discover.events(spark, DATA)).writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{DATA}/events.parquet").count()
    df = spark.createDataFrame([("a",)], "hostname string")
    sinks.publish(sinks.messages(df, "discoveries", "2024-01-31"), path=str(tmp_path / "m"))
    got = []
    q = discover.handle(files.subscribe(spark, ["discoveries"], path=str(tmp_path / "m")), lambda b, n: got.extend(r.key for r in b.collect()), str(tmp_path / "c"))
    q.awaitTermination(60)
    assert got == ["a"]
