"""Queries: relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import host as H
from ..operators import relate as R
from . import views as V
from .classify_queries import _FIRST, once
from .registry import query

_ENV = "(x.environment = y.environment AND x.environment <> 'unknown')"
_APP = "(x.application IS NOT DISTINCT FROM y.application AND x.application IS DISTINCT FROM 'unknown')"
_DC = "(x.datacenter = y.datacenter AND x.datacenter <> 'unknown')"


@query("d10_same_place", V.with_(V.HOSTS_SQL) + f"""SELECT x.hostname, min(CASE WHEN {_ENV} THEN y.hostname END) AS environment_class, min(CASE WHEN {_DC} THEN y.hostname END) AS datacenter_class,
 count(*) FILTER (x.hostname <> y.hostname AND {_ENV} AND {_APP}) AS same_application, count(*) FILTER (x.hostname <> y.hostname AND {_ENV} AND NOT {_APP}) AS same_environment,
 count(*) FILTER (x.hostname <> y.hostname AND NOT {_ENV} AND {_DC}) AS same_datacenter FROM hosts x, hosts y GROUP BY 1""")
def same_place(spark, sf):
    return R.same_place(V.hosts(spark, sf))


_KEYS = "keys AS (SELECT DISTINCT hostname, key FROM (" + " UNION ALL ".join(f"SELECT hostname, '{p}' || {c} AS key FROM hosts WHERE {H.sql_present(c)}" for c, p in (("environment", "env:"), ("datacenter", "dc:"), ("application", "app:"), ("owner", "owner:"))) + " UNION ALL SELECT hostname, attribute || ':' || lower(value) FROM firsts WHERE value <> ''))"
_SHARED = """shared AS (SELECT source, target, CASE via WHEN 'env' THEN 'same_environment' WHEN 'dc' THEN 'same_datacenter' WHEN 'app' THEN 'same_application' WHEN 'owner' THEN 'same_owner' ELSE 'shares_attribute' END AS type,
  CASE via WHEN 'env' THEN 0.5::DOUBLE WHEN 'dc' THEN 0.6::DOUBLE WHEN 'app' THEN 0.9::DOUBLE WHEN 'owner' THEN 0.5::DOUBLE ELSE 0.4::DOUBLE END AS confidence, via AS via_attribute
  FROM (SELECT a.hostname AS source, b.hostname AS target, split_part(key, ':', 1) AS via FROM keys a JOIN keys b USING (key) WHERE a.hostname < b.hostname AND key IN (SELECT key FROM keys GROUP BY key HAVING count(*) BETWEEN 2 AND 50)))"""


def network_sql(of):
    return f"""network AS (SELECT a.hostname AS source, b.hostname AS target, 'same_network' AS type, 0.7::DOUBLE AS confidence, 'subnet:' || subnet AS via_attribute FROM
  (SELECT *, row_number() OVER (PARTITION BY subnet ORDER BY hostname) AS rn, count(*) OVER (PARTITION BY subnet) AS n FROM (SELECT hostname, array_to_string(string_split(ip_address, '.')[1:3], '.') || '.0/24' AS subnet FROM {of} WHERE {H.sql_valid_ip('ip_address')})) a
  JOIN (SELECT *, row_number() OVER (PARTITION BY subnet ORDER BY hostname) AS rn FROM (SELECT hostname, array_to_string(string_split(ip_address, '.')[1:3], '.') || '.0/24' AS subnet FROM {of} WHERE {H.sql_valid_ip('ip_address')})) b USING (subnet)
  WHERE n BETWEEN 2 AND 100 AND b.rn BETWEEN a.rn + 1 AND a.rn + 9)"""


def hierarchy_sql(of):
    parent = "(starts_with(c.base, p.base || '-'))"
    return f"""parts AS (SELECT hostname, split_part(hostname, '.', 1) AS base FROM {of}),
tree AS (SELECT p.hostname AS source, c.hostname AS target, 'parent_of' AS type, 0.7::DOUBLE AS confidence, 'hostname_hierarchy' AS via_attribute FROM parts p JOIN parts c ON p.hostname <> c.hostname AND {parent}
  UNION ALL SELECT c.hostname, p.hostname, 'child_of', 0.7::DOUBLE, 'hostname_hierarchy' FROM parts p JOIN parts c ON p.hostname <> c.hostname AND {parent})"""


def cluster_sql(of):
    return f"""numbered AS (SELECT hostname, regexp_replace(hostname, '\\d+', '', 'g') AS base, try_cast(regexp_extract_all(hostname, '\\d+')[-1] AS HUGEINT) AS number FROM {of}),
sized AS (SELECT * FROM numbered WHERE base IN (SELECT base FROM numbered GROUP BY base HAVING count(*) BETWEEN 2 AND 20)),
gaps AS (SELECT base, number - lag(number) OVER (PARTITION BY base ORDER BY number) AS gap FROM sized WHERE number IS NOT NULL),
good AS (SELECT base FROM gaps WHERE gap IS NOT NULL GROUP BY base HAVING avg((gap BETWEEN 1 AND 10)::INT) > 0.5),
clustered AS (SELECT a.hostname AS source, b.hostname AS target, 'same_cluster' AS type, 0.8::DOUBLE AS confidence, 'cluster:' || base AS via_attribute FROM sized a JOIN sized b USING (base) WHERE a.hostname < b.hostname AND base IN (SELECT base FROM good))"""


_PATTERNS = f"""matched AS (SELECT a.hostname AS source, b.hostname AS target, a.environment, a.datacenter, t AS type, x, y FROM hosts a JOIN hosts b ON a.environment = b.environment AND a.datacenter = b.datacenter AND a.hostname <> b.hostname
  JOIN (VALUES {", ".join(f"('{a}', '{b}', '{t}')" for a, b, t in K.APPLICATION_PATTERNS)}) p(x, y, t) ON a.application = x AND b.application = y),
patterns AS (SELECT min(source) AS source, min(target) AS target, type, 0.8::DOUBLE AS confidence, 'app_pattern:' || x || '->' || y AS via_attribute, count(*) AS links FROM matched GROUP BY environment, datacenter, type, x, y)"""


def dedupe_sql(union, name="edges", directed=False):
    both = "false" if directed else "type IN (" + ", ".join(f"'{k}'" for k, (_, b, _) in K.RELATIONSHIP_TYPES.items() if b) + ")"
    return f"""{name} AS (SELECT source, target, type, confidence, via_attribute FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN {both} THEN least(source, target) ELSE source END, CASE WHEN {both} THEN greatest(source, target) ELSE target END, type ORDER BY confidence DESC, via_attribute, source, target) AS rn FROM ({union})) WHERE rn = 1)"""


EDGES_SQL = ",\n".join((V.HOSTS_SQL, network_sql("hosts"), hierarchy_sql("hosts"), cluster_sql("hosts"), dedupe_sql("SELECT * FROM network UNION ALL SELECT * FROM tree UNION ALL SELECT * FROM clustered")))


def edges(spark, sf):
    return R.named_edges(V.hosts(spark, sf))


_FIRSTS = (V.HOSTS_SQL, V.ATTRIBUTES_SQL, _FIRST, _KEYS, _SHARED)


@query("j1_shared_attributes", V.with_(*_FIRSTS) + "SELECT * FROM shared")
def shared_attributes(spark, sf):
    return R.shared_attributes(*once(spark, sf))


@query("j2_same_network", V.with_(V.HOSTS_SQL, network_sql("hosts")) + "SELECT * FROM network")
def same_network(spark, sf):
    return R.same_network(V.hosts(spark, sf))


@query("j3_application_patterns", V.with_(V.HOSTS_SQL, _PATTERNS) + "SELECT * FROM patterns")
def application_patterns(spark, sf):
    return R.application_patterns(V.hosts(spark, sf))


@query("j3_application_classes", V.with_(V.HOSTS_SQL) + "SELECT hostname, min(hostname) OVER (PARTITION BY environment, datacenter, coalesce(application, 'unknown')) AS first FROM hosts")
def application_classes(spark, sf):
    return R.application_classes(V.hosts(spark, sf))


@query("j4_hierarchy", V.with_(V.HOSTS_SQL, hierarchy_sql("hosts")) + "SELECT * FROM tree")
def hierarchy(spark, sf):
    return R.hierarchy_pairs(V.hosts(spark, sf))


@query("j4_label_classes", V.with_(V.HOSTS_SQL, hierarchy_sql("hosts")) + "SELECT hostname, base, min(hostname) OVER (PARTITION BY base) AS first FROM parts")
def label_classes(spark, sf):
    return R.label_classes(V.hosts(spark, sf))


@query("j5_clusters", V.with_(V.HOSTS_SQL, cluster_sql("hosts")) + "SELECT * FROM clustered")
def clusters(spark, sf):
    return R.clusters(V.hosts(spark, sf))


@query("j6_deduplicated", V.with_(EDGES_SQL) + "SELECT * FROM edges")
def deduplicated(spark, sf):
    return edges(spark, sf)


_ALL = (*_FIRSTS, network_sql("hosts"), _PATTERNS, hierarchy_sql("hosts"), cluster_sql("hosts"))
_UNION = "SELECT source, target, type, confidence, via_attribute FROM patterns UNION ALL " + " UNION ALL ".join(f"SELECT * FROM {t}" for t in ("shared", "network", "tree", "clustered"))
#: The same, pair by pair: no classes.
_PAIRS = "SELECT source, target, type, 0.8::DOUBLE AS confidence, 'app_pattern:' || x || '->' || y AS via_attribute FROM matched UNION ALL " + " UNION ALL ".join(f"SELECT * FROM {t}" for t in ("shared", "network", "tree", "clustered"))


@query("j7_directed_union", V.with_(*_ALL, dedupe_sql(_UNION, directed=True)) + "SELECT source, target, type, confidence FROM edges")
def directed_union(spark, sf):
    return R.deduplicate(R.families(*once(spark, sf)), directed=True).select("source", "target", "type", "confidence")


@query("j8_all_relationships", V.with_(*_ALL, dedupe_sql(_PAIRS)) + "SELECT type, count(*) AS n, round(avg(confidence), 9) AS confidence FROM edges GROUP BY 1")
def all_relationships(spark, sf):
    n = F.sum("links")
    return R.all_relationships(*once(spark, sf)).groupBy("type").agg(n.alias("n"), F.round(F.sum(F.col("confidence") * F.col("links")) / n, 9).alias("confidence"))


_CATALOGUE = ", ".join(f"('{k}', '{d}', {b}, {s}::DOUBLE)" for k, (d, b, s) in K.RELATIONSHIP_TYPES.items())


@query("j9_type_info", V.with_(EDGES_SQL) + f"SELECT e.source, e.target, e.type, coalesce(c.d, 'Unknown relationship type') AS description, coalesce(c.b, true) AS bidirectional, coalesce(c.s, 0.5) AS strength FROM edges e LEFT JOIN (VALUES {_CATALOGUE}) c(t, d, b, s) ON e.type = c.t")
def type_info(spark, sf):
    return R.type_info(edges(spark, sf)).select("source", "target", "type", "description", "bidirectional", "strength")




@query("j10_edges_with_ends", V.with_(EDGES_SQL) + "SELECT e.source, e.target, e.type FROM edges e WHERE source IN (SELECT hostname FROM hosts WHERE environment = 'production') AND target IN (SELECT hostname FROM hosts WHERE environment = 'production')")
def edges_with_ends(spark, sf):
    kept = V.hosts(spark, sf).filter("environment = 'production'").select("hostname")
    e = edges(spark, sf)
    return e.join(kept.withColumnRenamed("hostname", "source"), "source", "left_semi").join(kept.withColumnRenamed("hostname", "target"), "target", "left_semi").select("source", "target", "type")


@query("j11_orphans", V.with_(EDGES_SQL) + "SELECT hostname FROM hosts WHERE hostname NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)")
def orphans(spark, sf):
    e = edges(spark, sf)
    return V.hosts(spark, sf).select("hostname").join(e.select(F.col("source").alias("hostname")).union(e.select("target")), "hostname", "left_anti")
