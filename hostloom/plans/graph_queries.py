"""Queries: graph of hosts and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import relate as R
from ..operators import walks as W
from ..operators.lineage import cut
from . import views as V
from .registry import query
from .relate_queries import EDGES_SQL, edges

NODE, OTHER = "web-prod", "web-prod-a-1"
_VERTICES = "vertices AS (SELECT hostname AS id FROM hosts)"
_BASE = V.with_(EDGES_SQL, _VERTICES)
_PAIR = "pairs AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM edges WHERE source <> target)"


def vertices(spark, sf):
    return V.hosts(spark, sf).select(F.col("hostname").alias("id"))


def found_once(spark, sf):
    """Vertices and edges of hosts that are found once."""
    hosts = cut(V.hosts(spark, sf).select("hostname", "ip_address"))
    return hosts.select(F.col("hostname").alias("id")), R.named_edges(hosts)


@query("g1_vertices_edges", _BASE + "SELECT id, count(e.source) AS out_edges FROM vertices LEFT JOIN edges e ON id = source GROUP BY 1")
def vertices_edges(spark, sf):
    e = edges(spark, sf)
    return G.with_vertices(vertices(spark, sf), e).join(e, F.col("id") == F.col("source"), "left").groupBy("id").agg(F.count("source").alias("out_edges"))


@query("g2_measures", _BASE + "SELECT n, m, round(m / (n * (n - 1)), 12) AS density, round(2 * m / n, 9) AS degree FROM (SELECT count(*) AS n FROM vertices), (SELECT count(*) AS m FROM edges)")
def measures(spark, sf):
    return G.measures(vertices(spark, sf), edges(spark, sf)).select("n", "m", F.round("density", 12).alias("density"), F.round("degree", 9).alias("degree"))


_RECURSIVE = "WITH RECURSIVE " + ",\n".join((EDGES_SQL, _VERTICES, _PAIR, "sym AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs)", "walk(id, root) AS (SELECT id, id FROM vertices UNION SELECT s.b, w.root FROM walk w JOIN sym s ON s.a = w.id WHERE w.root < s.b)", "member AS (SELECT id, min(root) AS component FROM walk GROUP BY 1)")) + "\n"


def membership(spark, sf):
    return G.components(vertices(spark, sf), edges(spark, sf))


@query("g3_components", _RECURSIVE + "SELECT id, component FROM member")
def components(spark, sf):
    return membership(spark, sf)


_DEGREE = "deg AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY 1), tri AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM pairs x JOIN pairs y ON x.a = y.a AND x.b < y.b JOIN pairs z ON z.a = x.b AND z.b = y.b), tc AS (SELECT id, count(*) AS t FROM (SELECT p AS id FROM tri UNION ALL SELECT q FROM tri UNION ALL SELECT r FROM tri) GROUP BY 1)"


@query("g4_clustering", V.with_(EDGES_SQL, _VERTICES, _PAIR, _DEGREE) + "SELECT id, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 9) AS clustering FROM vertices LEFT JOIN deg USING (id) LEFT JOIN tc USING (id)")
def clustering(spark, sf):
    return G.clustering(vertices(spark, sf), edges(spark, sf)).select("id", F.round("clustering", 9).alias("clustering"))


_TOTAL = "total AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY 1)"


@query("g5_degree", V.with_(EDGES_SQL, _VERTICES, _TOTAL) + "SELECT id, coalesce(degree, 0) AS degree, round(coalesce(degree, 0) / ((SELECT count(*) FROM vertices) - 1), 9) AS centrality FROM vertices LEFT JOIN total USING (id)")
def degree(spark, sf):
    return G.degree(vertices(spark, sf), edges(spark, sf)).withColumn("centrality", F.round("centrality", 9))


#: Ranks after as many rounds as make them exact to 12 digits.
_RANKS = """outs AS (SELECT source, count(*) AS o FROM edges GROUP BY 1), size AS (SELECT count(*)::DOUBLE AS n FROM vertices),
ends AS MATERIALIZED (SELECT source, target, count(*) / any_value(o)::DOUBLE AS share FROM edges JOIN outs USING (source) GROUP BY 1, 2), base AS MATERIALIZED (SELECT id, n, id IN (SELECT source FROM outs) AS sends FROM vertices, size),
ranks(k, id, rank) AS (SELECT 0, id, 1 / n FROM base UNION ALL
  SELECT k + 1, id, 0.85::DOUBLE * sum(got) + 0.15::DOUBLE / any_value(n) FROM (
    SELECT r.k, e.target AS id, r.rank * share AS got FROM ranks r JOIN ends e ON r.id = e.source
    UNION ALL SELECT l.k, b.id, l.lost / b.n FROM base b, (SELECT k, coalesce(sum(rank) FILTER (NOT sends), 0) AS lost FROM ranks JOIN base USING (id) GROUP BY 1) l) JOIN base USING (id) WHERE k < 150 GROUP BY 1, 2)"""


@query("g6_pagerank", "WITH RECURSIVE " + ",\n".join((EDGES_SQL, _VERTICES, _RANKS)) + "\nSELECT id, round(rank, 8) AS rank FROM ranks WHERE k = 150")
def pagerank(spark, sf):
    return G.pagerank(vertices(spark, sf), edges(spark, sf)).select("id", F.round("rank", 8).alias("rank"))


def _searched(vertices, edges):
    """Views dist (hops from s to v) and paths (how many shortest ones) of a graph, from all vertices."""
    return f"""arcs AS MATERIALIZED (SELECT DISTINCT source AS a, target AS b FROM {edges} WHERE source <> target AND source IN (SELECT id FROM {vertices}) AND target IN (SELECT id FROM {vertices})),
hop(s, v, d) AS (SELECT id, id, 0 FROM {vertices} UNION SELECT s, b, d + 1 FROM hop JOIN arcs ON a = v WHERE d < 12),
dist AS MATERIALIZED (SELECT s, v, min(d) AS d FROM hop GROUP BY 1, 2),
sigma(s, v, d, n) AS (SELECT s, v, 0, 1::DOUBLE FROM dist WHERE d = 0 UNION ALL SELECT x.s, b, x.d + 1, sum(n) FROM sigma x JOIN arcs ON a = x.v JOIN dist y ON y.s = x.s AND y.v = b AND y.d = x.d + 1 GROUP BY 1, 2, 3),
paths AS MATERIALIZED (SELECT s, v, d, n FROM sigma)"""


_BETWEEN = """size AS (SELECT count(*) AS n FROM vertices), between AS MATERIALIZED (SELECT id, coalesce(x, 0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1 END AS betweenness FROM size, vertices LEFT JOIN (
  SELECT f.v AS id, sum(f.n * g.n / w.n) AS x FROM paths f JOIN paths g ON g.s = f.v JOIN paths w ON w.s = f.s AND w.v = g.v WHERE f.d > 0 AND g.d > 0 AND w.d = f.d + g.d GROUP BY 1) USING (id))"""


@query("g7_betweenness", "WITH RECURSIVE " + ",\n".join((EDGES_SQL, _VERTICES, _searched("vertices", "edges"), _BETWEEN)) + "\nSELECT id, round(betweenness, 9) AS betweenness FROM between")
def betweenness(spark, sf):
    return G.betweenness(*found_once(spark, sf)).withColumn("betweenness", F.round("betweenness", 9))


_LARGEST = "largest AS (SELECT id FROM member WHERE component = (SELECT component FROM member GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1))"


@query("g8_closeness", _RECURSIVE.rstrip() + ",\n" + _LARGEST + ",\n" + _searched("largest", "edges") + "\nSELECT id, round(coalesce(r / far * r / ((SELECT count(*) FROM largest) - 1), 0), 9) AS closeness FROM largest LEFT JOIN (SELECT v AS id, count(*) AS r, sum(d) AS far FROM dist WHERE d > 0 GROUP BY 1) USING (id)")
def closeness(spark, sf):
    """Of the largest component: closeness is for connected graphs."""
    v, e = found_once(spark, sf)
    member = cut(G.components(v, e))
    largest = member.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    kept = member.join(largest, "component", "left_semi").select("id")
    return G.closeness(kept, G.subgraph(e, kept)).withColumn("closeness", F.round("closeness", 9))


def critical(spark, sf):
    return G.critical_nodes(*found_once(spark, sf))


@query("g9_critical_nodes", "WITH RECURSIVE " + ",\n".join((EDGES_SQL, _VERTICES, _searched("vertices", "edges"), _BETWEEN, _RANKS.replace("size AS", "sizes AS").replace("vertices, size)", "vertices, sizes)"), _TOTAL)) + "\nSELECT id, round(score, 9) AS score FROM (SELECT id, coalesce(degree, 0) / ((SELECT count(*) FROM vertices) - 1) + betweenness + rank AS score FROM vertices LEFT JOIN total USING (id) JOIN between USING (id) JOIN (SELECT id, rank FROM ranks WHERE k = 150) USING (id)) WHERE score > 0.5 ORDER BY id LIMIT 20")
def critical_nodes(spark, sf):
    return critical(spark, sf).withColumn("score", F.round("score", 9))


#: Stated critical hosts, as many as are looked at.
CRITICAL = ["srv", "web-prod", "web-prod-a-1", "db-stg", "api-dev", "lb"]


_INTERNAL = "SELECT component, count(*) AS internal FROM edges JOIN member ON source = id GROUP BY 1"
_MODAL = "SELECT component, arg_min(environment, (-k, environment)) AS environment FROM (SELECT component, environment, count(*) AS k FROM member JOIN hosts ON id = hostname GROUP BY 1, 2) GROUP BY 1"


@query("g10_communities", _RECURSIVE + f"SELECT component, size, coalesce(internal, 0) AS internal, round(CASE WHEN size > 1 THEN coalesce(internal, 0) / (size * (size - 1)) ELSE 0 END, 9) AS density, environment, members FROM (SELECT component, count(*) AS size, array_to_string(list_sort(list(id))[1:20], ',') AS members FROM member GROUP BY 1) LEFT JOIN ({_INTERNAL}) USING (component) LEFT JOIN ({_MODAL}) USING (component)")
def communities(spark, sf):
    hosts, e = cut(V.hosts(spark, sf)), edges(spark, sf)
    member = cut(G.components(hosts.select(F.col("hostname").alias("id")), e))
    return G.communities(member, e, hosts).withColumn("density", F.round("density", 9))


@query("g11_g20_shortest_path", _RECURSIVE.replace("member AS", f"bfs(id, hops) AS (SELECT '{NODE}', 0 UNION SELECT target, hops + 1 FROM bfs JOIN edges ON source = id WHERE hops < 4), member AS") + f"SELECT min(hops) AS length FROM bfs WHERE id = '{OTHER}' HAVING count(*) > 0")
def shortest_path(spark, sf):
    return G.shortest_path(edges(spark, sf), NODE, OTHER).select("length")


_STARTS = ", ".join(f"('{a}', '{b}')" for k, a in enumerate(CRITICAL[:5]) for b in CRITICAL[k + 1 : 6])
_PATHS = f"""wanted(s, e) AS (VALUES {_STARTS}),
hop(s, id, path) AS (SELECT DISTINCT s, s, [s] FROM wanted UNION ALL SELECT s, target, min(list_append(path, target)) FROM hop JOIN edges ON source = id WHERE len(path) < 8 GROUP BY s, target, len(path)),
shortest AS (SELECT s, e, min(path) AS path FROM wanted JOIN hop USING (s) JOIN (SELECT s, id, min(len(path)) AS n FROM hop GROUP BY 1, 2) m USING (s, id) WHERE id = e AND len(path) = n GROUP BY 1, 2),
critical_paths AS (SELECT s AS start, e AS "end", path, len(path) - 1 AS length FROM shortest WHERE len(path) > 2)"""


@query("g11_critical_paths", "WITH RECURSIVE " + ",\n".join((EDGES_SQL, _PATHS)) + "\nSELECT start, \"end\", array_to_string(path, ' > ') AS path, CAST(length AS INT) AS length FROM critical_paths")
def critical_paths(spark, sf):
    return G.critical_paths(edges(spark, sf), CRITICAL).withColumn("path", F.array_join("path", " > "))


#: A vertex whose neighbours don't all reach each other without it.
_PARTED = """near AS (SELECT id AS gone, min(b) AS start, count(DISTINCT b) AS n FROM vertices JOIN sym ON a = id AND b <> a GROUP BY 1),
around(gone, v) AS (SELECT gone, start FROM near WHERE n > 1 UNION SELECT w.gone, b FROM around w JOIN sym ON a = w.v WHERE b <> w.gone)"""


@query("g12_articulation_points", _RECURSIVE.rstrip() + ",\n" + _PARTED + "\nSELECT DISTINCT gone AS id FROM near JOIN sym ON a = gone AND b <> a WHERE n > 1 AND (gone, b) NOT IN (SELECT gone, v FROM around)")
def articulation_points(spark, sf):
    return G.articulation_points(vertices(spark, sf), edges(spark, sf))


def _share(c):
    return f"('0x' || left(md5(coalesce({c}, 'unknown')), 8))::BIGINT % 1000 / 1000.0::DOUBLE"


@query("g13_node_features", V.with_(V.HOSTS_SQL) + f"SELECT hostname AS id, list_concat([{', '.join(_share(c) for c in ('hostname', 'environment', 'datacenter', 'application'))}, confidence], list_transform(range(59), lambda x: 0::DOUBLE)) AS features FROM hosts")
def node_features(spark, sf):
    return G.node_features(V.hosts(spark, sf))


_NEAR = """near AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges) WHERE a <> b),
adj AS MATERIALIZED (SELECT a, row_number() OVER (PARTITION BY a ORDER BY left(md5(b), 1), b) - 1 AS k, b, count(*) OVER (PARTITION BY a) AS d FROM near),
steps(walk, node, r, path) AS (SELECT id || '#' || j, id, 0, [id] FROM vertices, (SELECT unnest(range(3)) AS j)
  UNION ALL SELECT walk, b, r + 1, list_append(path, b) FROM steps JOIN adj ON a = node AND k = ('0x' || left(md5('42|' || walk || '|' || r), 8))::BIGINT % d WHERE r < 7)"""


@query("g13_walks", "WITH RECURSIVE " + ",\n".join((EDGES_SQL, _VERTICES, _NEAR)) + "\nSELECT walk, array_to_string(arg_max(path, r), ' ') AS path FROM steps GROUP BY 1")
def walks(spark, sf):
    return W.walks(vertices(spark, sf), edges(spark, sf), each=3, length=8).withColumn("path", F.array_join("path", " "))


@query("g13_embeddings")
def embeddings(spark, sf):
    return W.embeddings(W.walks(vertices(spark, sf), edges(spark, sf), each=10, length=20))


_LEVELS = [("environment", "''", "environment"), ("datacenter", "environment", "datacenter"), ("application", "environment || '/' || datacenter", "application"), ("host", "environment || '/' || datacenter || '/' || application", "hostname")]


@query("g14_hierarchy", V.with_(V.HOSTS_SQL, "named AS (SELECT hostname, environment, datacenter, coalesce(application, 'unknown') AS application FROM hosts)") + " UNION ALL ".join(f"SELECT '{level}' AS level, {up} AS parent, {name} AS name, count(*) AS n FROM named GROUP BY ALL" for level, up, name in _LEVELS))
def hierarchy(spark, sf):
    return G.hierarchy(V.hosts(spark, sf))


@query("g15_node_export", V.with_(EDGES_SQL, _VERTICES, _PAIR, _DEGREE, _TOTAL) + "SELECT hostname AS id, environment, host_type, coalesce(degree, 0) AS degree, round(CASE WHEN d > 1 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 9) AS clustering FROM hosts LEFT JOIN total ON hostname = total.id LEFT JOIN deg ON hostname = deg.id LEFT JOIN tc ON hostname = tc.id")
def node_export(spark, sf):
    hosts, e = cut(V.hosts(spark, sf)), edges(spark, sf)
    v = hosts.select(F.col("hostname").alias("id"))
    info = hosts.select(F.col("hostname").alias("id"), "environment", "host_type")
    return info.join(G.degree(v, e).select("id", "degree"), "id").join(G.clustering(v, e).withColumn("clustering", F.round("clustering", 9)), "id")


@query("g16_neighbours", _BASE + f"SELECT 'upstream' AS direction, source AS id, type, confidence FROM edges WHERE target = '{NODE}' UNION ALL SELECT 'downstream', target, type, confidence FROM edges WHERE source = '{NODE}'")
def neighbours(spark, sf):
    return G.neighbours(edges(spark, sf), NODE)


def _bfs(direction):
    a, b = ("target", "source") if direction else ("source", "target")
    return _RECURSIVE.replace("member AS", f"bfs(id, hops) AS (SELECT '{NODE}', 0 UNION SELECT {b}, hops + 1 FROM bfs JOIN edges ON {a} = id WHERE hops < 3), member AS")


for _key, _back in (("g16_upstream", True), ("g16_downstream", False)):
    query(_key, _bfs(_back) + f"SELECT id, CAST(min(hops) AS INT) AS hops FROM bfs WHERE id <> '{NODE}' GROUP BY 1")(lambda spark, sf, back=_back: G.reach(edges(spark, sf), NODE, 3, back))


@query("g17_impact", _RECURSIVE.replace("member AS", f"down(id) AS (SELECT '{NODE}' UNION SELECT target FROM down JOIN edges ON source = id), {_PATHS}, member AS") + f"SELECT (SELECT count(DISTINCT id) FROM (SELECT source AS id FROM edges WHERE target = '{NODE}' UNION ALL SELECT target FROM edges WHERE source = '{NODE}')) AS neighbours, count(*) AS downstream, count(DISTINCT component) AS communities, (SELECT count(*) FROM critical_paths WHERE list_has_any(path, (SELECT list(id) FROM down))) AS critical_paths FROM down JOIN member USING (id) WHERE id <> '{NODE}'")
def impact(spark, sf):
    e = edges(spark, sf)
    return G.impact(e, NODE, G.components(vertices(spark, sf), e), G.critical_paths(e, CRITICAL))


_V = "[coalesce(cpu_cores, 0)::DOUBLE, coalesce(memory_gb, 0)::DOUBLE, n_sources::DOUBLE]"


@query("g18_similar", V.with_(V.HOSTS_SQL) + f"""SELECT h.hostname, round(CASE WHEN h.host_type = o.host_type THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN h.environment = o.environment THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN h.datacenter = o.datacenter THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN h.application = o.application THEN 0.2::DOUBLE ELSE 0 END
  + list_cosine_similarity({_V.replace('(', '(h.').replace('n_s', 'h.n_s')}, {_V.replace('(', '(o.').replace('n_s', 'o.n_s')}) * 0.2::DOUBLE, 9) AS score FROM hosts h, hosts o WHERE o.hostname = '{NODE}' AND h.hostname <> '{NODE}' ORDER BY score DESC, h.hostname LIMIT 10""")
def similar(spark, sf):
    return G.similar(V.hosts(spark, sf), NODE)


@query("g19_subgraph", _BASE + "SELECT source, target, type FROM edges WHERE source LIKE 'web%' AND target LIKE 'web%'")
def subgraph(spark, sf):
    return G.subgraph(edges(spark, sf), vertices(spark, sf).filter("id like 'web%'")).select("source", "target", "type")


@query("g21_statistics", V.with_(EDGES_SQL, _VERTICES, _TOTAL) + "SELECT count(*) AS vertices, round(avg(coalesce(degree, 0)), 9) AS average, max(coalesce(degree, 0)) AS most, min(coalesce(degree, 0)) AS least, count(*) FILTER (degree IS NULL) AS isolated FROM vertices LEFT JOIN total USING (id)")
def statistics(spark, sf):
    return G.statistics(vertices(spark, sf), edges(spark, sf)).withColumn("average", F.round("average", 9))


@query("g22_cytoscape", _BASE + """SELECT '{"group":"nodes","data":{"id":"' || id || '"}}' AS element FROM vertices UNION ALL SELECT '{"group":"edges","data":{"source":"' || source || '","target":"' || target || '","type":"' || type || '","confidence":' || confidence || '}}' FROM edges""")
def cytoscape(spark, sf):
    return G.cytoscape(vertices(spark, sf), edges(spark, sf))


@query("g22_graphml", _BASE + f"""SELECT unnest(['{G.GRAPHML_HEAD}', '{G.GRAPHML_FOOT}']) AS line UNION ALL SELECT '<node id="' || id || '"/>' FROM vertices UNION ALL SELECT '<edge source="' || source || '" target="' || target || '"><data key="type">' || type || '</data></edge>' FROM edges""")
def graphml(spark, sf):
    return G.graphml(vertices(spark, sf), edges(spark, sf))
