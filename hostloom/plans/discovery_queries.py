"""Queries: predicates on names and values, and discovery of hosts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import host as H
from ..operators import discovery as D
from ..operators import graph as G
from ..operators import scan as S
from ..sources.inventory import table
from . import views as V
from .registry import query

# Column catalog: names of all columns of the base tables and of the raw inventory
CATALOG_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def catalog(spark, sf):
    """table_name, column_name, data_type, ordinal from schemas alone; no data is read."""
    rows = [(t, f.name, f.dataType.simpleString(), k) for t in CATALOG_TABLES for k, f in enumerate(table(spark, sf, t).schema)]
    rows += [("host_raw", f.name, f.dataType.simpleString(), k) for k, f in enumerate(V.raw(spark, sf).schema)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, ordinal int")


_CATALOG = V.RAW_SQL + ", catalog AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name FROM (DESCRIBE SELECT * FROM {t})" for t in [*CATALOG_TABLES, "host_raw"]) + ")"


def _rules(category):
    return ", ".join(f"CASE WHEN regexp_full_match(lower(column_name), '{p}') THEN {c}::DOUBLE END" for p, c in K.COLUMN_RULES[category])


for _key, _category, _above in (("p1_hostname_columns", "hostname", 0.5), ("p2_ip_columns", "ip", 0.5), ("p3_environment_columns", "environment", 0.0), ("p4_application_columns", "application", 0.0)):
    query(_key, f"WITH {_CATALOG} SELECT * FROM (SELECT table_name, column_name, greatest({_rules(_category)}) AS confidence FROM catalog) WHERE confidence > {_above}")(
        lambda spark, sf, category=_category, above=_above: D.find_columns(catalog(spark, sf), category, above)
    )


@query("p5_other_columns", f"WITH {_CATALOG} " + " UNION ALL ".join(f"SELECT '{c}' AS category, * FROM (SELECT table_name, column_name, greatest({_rules(c)}) AS confidence FROM catalog) WHERE confidence > 0" for c in ("owner", "location", "cluster", "project")))
def other_columns(spark, sf):
    frames = [D.find_columns(catalog(spark, sf), c, 0.0).select(F.lit(c).alias("category"), "*") for c in ("owner", "location", "cluster", "project")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).unionByName(frames[3])


_LIKE = " OR ".join(f"lower(column_name) LIKE '%{p}%'" for p in K.SEARCHED_COLUMNS)


@query("s10_column_search", f"WITH {_CATALOG} SELECT table_name, column_name FROM catalog WHERE {_LIKE}")
def column_search(spark, sf):
    name = F.lower("column_name")
    fits = F.lit(False)
    for p in K.SEARCHED_COLUMNS:
        fits = fits | name.like(f"%{p}%")
    return catalog(spark, sf).filter(fits).select("table_name", "column_name")


@query("s11_column_search_exact", f"WITH {_CATALOG} SELECT DISTINCT table_name, column_name FROM catalog WHERE lower(column_name) IN ({', '.join(repr(p) for p in K.SEARCHED_COLUMNS)})")
def column_search_exact(spark, sf):
    return catalog(spark, sf).filter(F.lower("column_name").isin(K.SEARCHED_COLUMNS)).select("table_name", "column_name").distinct()


@query("s1_tables", f"WITH {_CATALOG} SELECT table_name, count(*) AS n_columns FROM catalog GROUP BY 1")
def tables(spark, sf):
    return catalog(spark, sf).groupBy("table_name").agg(F.count("*").alias("n_columns"))


@query("p10_sanitized_names", f"WITH {_CATALOG} SELECT column_name, lower(left(CASE WHEN regexp_matches(p, '^\\d') THEN 'col_' || p ELSE p END, 64)) AS sanitized FROM (SELECT column_name, regexp_replace(column_name || '-' || table_name, '[^A-Za-z0-9_]', '_', 'g') AS p FROM catalog)")
def sanitized_names(spark, sf):
    return catalog(spark, sf).select("column_name", H.sanitized(F.concat_ws("-", "column_name", "table_name")).alias("sanitized"))


_LOOSE = f"coalesce(length(host_name) BETWEEN 1 AND 253 AND NOT contains(host_name, ' ') AND regexp_matches(host_name, '{K.LOOSE_HOSTNAME}'), false)"


@query("s13_looks_like_hostname", V.with_(V.RAW_SQL) + f"SELECT host_name, {_LOOSE} AS looks FROM host_raw")
def looks_like(spark, sf):
    return V.raw(spark, sf).select("host_name", H.looks_like_hostname(F.col("host_name")).alias("looks"))


@query("s14_training_export", f"WITH {_CATALOG} SELECT DISTINCT 'hostname' AS kind, host_name AS value FROM host_raw WHERE {_LOOSE} UNION ALL SELECT DISTINCT 'table', table_name FROM catalog UNION ALL SELECT DISTINCT 'column', column_name FROM catalog")
def training_export(spark, sf):
    return S.training_export(V.raw(spark, sf), catalog(spark, sf))


@query("s14_scan_statistics", f"WITH {_CATALOG} SELECT (SELECT count(DISTINCT table_name) FROM catalog) AS n_tables, (SELECT count(*) FROM catalog) AS n_columns, (SELECT count(DISTINCT host_name) FROM host_raw WHERE {_LOOSE}) AS n_hostnames")
def scan_statistics(spark, sf):
    return S.scan_statistics(S.training_export(V.raw(spark, sf), catalog(spark, sf)), catalog(spark, sf))


@query("p6_valid_hostname", V.with_(V.RAW_SQL) + f"SELECT host_name, {H.sql_valid_hostname('host_name')} AS valid FROM host_raw")
def valid_hostname(spark, sf):
    return V.raw(spark, sf).select("host_name", H.valid_hostname(F.col("host_name")).alias("valid"))


@query("p7_valid_ip", V.with_(V.RAW_SQL) + f"SELECT ip_address, {H.sql_valid_ip('ip_address')} AS valid FROM host_raw")
def valid_ip(spark, sf):
    return V.raw(spark, sf).select("ip_address", H.valid_ip(F.col("ip_address")).alias("valid"))


@query("p8_four_octets", V.with_(V.RAW_SQL) + "SELECT ip_address, coalesce(len(string_split(ip_address, '.')) = 4 AND list_bool_and(list_transform(string_split(ip_address, '.'), lambda o: coalesce(try_cast(trim(o) AS INT) BETWEEN 0 AND 255, false))), false) AS valid FROM host_raw")
def four_octets(spark, sf):
    return V.raw(spark, sf).select("ip_address", H.four_octets(F.col("ip_address")).alias("valid"))


@query("p9_ip_shape", V.with_(V.RAW_SQL) + f"SELECT ip_address, coalesce(regexp_matches(ip_address, '{K.IPV4}'), false) AS shaped FROM host_raw")
def ip_shape(spark, sf):
    return V.raw(spark, sf).select("ip_address", H.ip_shaped(F.col("ip_address")).alias("shaped"))


_TYPE = r"""CASE WHEN json_valid(value) THEN 'json' WHEN regexp_matches(value, '^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$') OR lower(trim(value)) IN ('inf', '+inf', '-inf', 'infinity', 'nan') THEN 'numeric'
  WHEN regexp_matches(value, '^\d{4}-\d{2}-\d{2}') THEN 'date' WHEN lower(value) IN ('true', 'false', 'yes', 'no', '1', '0') THEN 'boolean' ELSE 'text' END"""


@query("p11_attribute_type", V.with_(V.PICKED_SQL, V.ATTRIBUTES_SQL) + f"SELECT attribute, {_TYPE} AS type, count(*) AS n FROM attributes GROUP BY 1, 2")
def attribute_type(spark, sf):
    return D.attributes(V.picked(spark, sf)).select("attribute", H.attribute_type(F.col("value")).alias("type")).groupBy("attribute", "type").agg(F.count("*").alias("n"))


@query("p12_free_text_search", V.with_(V.HOSTS_SQL) + "SELECT hostname FROM hosts WHERE contains(lower(concat_ws('|', hostname, ip_address, environment, application, owner, os_type, datacenter)), 'web') ORDER BY hostname LIMIT 100")
def search(spark, sf):
    text = F.lower(F.concat_ws("|", "hostname", "ip_address", "environment", "application", "owner", "os_type", "datacenter"))
    return V.hosts(spark, sf).filter(text.contains("web")).select("hostname").orderBy("hostname").limit(100)


@query("p13_name_catalogue", V.with_(V.HOSTS_SQL) + "SELECT " + ", ".join(f"count(*) FILTER (regexp_matches(hostname, '{p}')) AS {n}" for n, p in K.NAME_CATALOGUE.items()) + " FROM hosts")
def name_catalogue(spark, sf):
    return V.hosts(spark, sf).agg(*(F.count_if(F.col("hostname").rlike(p)).alias(n) for n, p in K.NAME_CATALOGUE.items()))


@query("d1_pick_hostname", V.with_(V.PICKED_SQL) + "SELECT table_name, row_id, hostname, confidence FROM picked")
def pick(spark, sf):
    return V.picked(spark, sf).select("table_name", "row_id", "hostname", "confidence")


@query("d2_group_hosts", V.with_(V.PICKED_SQL) + "SELECT hostname, count(*) AS n_sources, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS tables, max(confidence) AS confidence FROM picked GROUP BY 1")
def group_hosts(spark, sf):
    return V.picked(spark, sf).groupBy("hostname").agg(F.count("*").alias("n_sources"), F.array_join(F.array_sort(F.collect_set("table_name")), ",").alias("tables"), F.max("confidence").alias("confidence"))


@query("d3_attributes", V.with_(V.PICKED_SQL, V.ATTRIBUTES_SQL) + "SELECT hostname, attribute, count(*) AS n FROM attributes GROUP BY 1, 2")
def attribute_counts(spark, sf):
    return D.attributes(V.picked(spark, sf)).groupBy("hostname", "attribute").agg(F.count("*").alias("n"))


@query(
    "d4_attribute_values",
    V.with_(V.PICKED_SQL, V.ATTRIBUTES_SQL)
    + """SELECT hostname, attribute, CAST(row_number() OVER (PARTITION BY hostname, attribute ORDER BY first.table_name, first.row_id, folded) AS INT) AS place, first.value AS value
FROM (SELECT hostname, attribute, lower(value) AS folded, min({'table_name': table_name, 'row_id': row_id, 'value': value}) AS first FROM attributes GROUP BY 1, 2, 3)""",
)
def attribute_values(spark, sf):
    return D.distinct_attributes(V.picked(spark, sf))


@query("d5_environment", V.with_(V.HOSTS_SQL) + f"SELECT hostname, {H.sql_first_keyword('hostname', K.ENVIRONMENTS, repr('unknown'))} AS inferred FROM hosts")
def environment(spark, sf):
    return V.hosts(spark, sf).select("hostname", H.first_keyword(F.lower("hostname"), K.ENVIRONMENTS, "unknown").alias("inferred"))


@query("d6_datacenter", V.with_(V.HOSTS_SQL) + "SELECT hostname, datacenter FROM hosts")
def datacenter(spark, sf):
    return V.hosts(spark, sf).select("hostname", "datacenter")


@query("d7_host_type", V.with_(V.HOSTS_SQL) + "SELECT host_type, count(*) AS n FROM hosts GROUP BY 1")
def host_type(spark, sf):
    return V.hosts(spark, sf).groupBy("host_type").agg(F.count("*").alias("n"))


@query("d8_quality", V.with_(V.HOSTS_SQL) + "SELECT hostname, environment, application, owner, round(quality_score, 9) AS quality_score FROM hosts")
def quality(spark, sf):
    return V.hosts(spark, sf).select("hostname", "environment", "application", "owner", F.round("quality_score", 9).alias("quality_score"))


_KEYS = "keyed AS (SELECT hostname, quality_score, 'ip:' || ip_address AS key FROM hosts WHERE ip_address IS NOT NULL UNION ALL SELECT hostname, quality_score, 'base:' || CASE WHEN contains(hostname, '.') THEN split_part(hostname, '.', 1) ELSE regexp_replace(hostname, '\\d+', '', 'g') END FROM hosts)"


@query("d9_duplicate_groups", V.with_(V.HOSTS_SQL, _KEYS) + "SELECT key, arg_min(hostname, (-quality_score, hostname)) AS best, count(*) AS n FROM keyed GROUP BY key HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return D.duplicate_groups(V.hosts(spark, sf))




@query("d11_merged_sources", V.with_(V.PICKED_SQL, V.ATTRIBUTES_SQL) + """SELECT hostname, n_rows, sources, coalesce(n_attributes, 0) AS n_attributes, coalesce(n_values, 0) AS n_values FROM (SELECT hostname, count(*) AS n_rows, string_agg(DISTINCT table_name, ',' ORDER BY table_name) AS sources FROM picked GROUP BY 1)
LEFT JOIN (SELECT hostname, count(DISTINCT attribute) AS n_attributes, count(*) AS n_values FROM (SELECT DISTINCT hostname, attribute, lower(value) FROM attributes) GROUP BY 1) USING (hostname)""")
def merged_sources(spark, sf):
    return D.merged_sources(V.picked(spark, sf))


@query("d11_merged_attributes", V.with_(V.PICKED_SQL, V.ATTRIBUTES_SQL) + "SELECT hostname, attribute, table_name, CAST(row_number() OVER (PARTITION BY hostname, attribute ORDER BY table_name, row_id, value) AS INT) AS place, value FROM attributes")
def merged_attributes(spark, sf):
    return D.merged_attributes(V.picked(spark, sf))


_LINKS = "links AS (SELECT DISTINCT a.hostname AS x, b.hostname AS y FROM keyed a JOIN keyed b USING (key))"
_WALK = "walk(id, root) AS (SELECT hostname, hostname FROM hosts UNION SELECT l.y, w.root FROM walk w JOIN links l ON l.x = w.id WHERE w.root < l.y), member AS (SELECT id AS hostname, min(root) AS component FROM walk GROUP BY 1)"


@query(
    "d9_merged_hosts",
    "WITH RECURSIVE " + ",\n".join((V.HOSTS_SQL, _KEYS, _LINKS, _WALK))
    + """
SELECT b.hostname, b.environment, b.application, b.ip_address, n_hosts, n_sources, confidence FROM (
  SELECT arg_min({'hostname': hostname, 'environment': environment, 'application': application, 'ip_address': ip_address}, (-quality_score, hostname)) AS b, count(*) AS n_hosts, sum(n_sources)::BIGINT AS n_sources, max(confidence) AS confidence
  FROM hosts JOIN member USING (hostname) GROUP BY component)""",
)
def merged_hosts(spark, sf):
    hosts = V.hosts(spark, sf)
    groups = G.components(hosts.select(F.col("hostname").alias("id")), D.duplicate_links(hosts))
    return D.merge_duplicates(hosts, groups)
