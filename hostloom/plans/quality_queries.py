"""Queries: quality, anomalies, insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import host as H
from ..operators import classify as C
from ..operators import quality as Q
from ..operators import relate as R
from ..operators.lineage import cut
from . import views as V
from .classify_queries import CLASSES_SQL, once
from .registry import query
from .relate_queries import EDGES_SQL, edges

NOW = "2024-01-31 00:00:00"
_VALID_ROW = f"(CASE WHEN {H.sql_valid_hostname('hostname')} THEN 1 ELSE 0 END + CASE WHEN ip_address IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN cpu_cores BETWEEN 1 AND 256 THEN 1 ELSE 0 END)::DOUBLE / (1 + (ip_address IS NOT NULL)::INT + (cpu_cores IS NOT NULL AND cpu_cores <> 0)::INT)"
_SEEN = "try_strptime(last_seen, '%Y-%m-%dT%H:%M:%S')"
_DAYS = f"floor((epoch(TIMESTAMP '{NOW}') - epoch({_SEEN})) / 86400)"
_AGE = f"CASE WHEN last_seen IS NULL OR last_seen = '' THEN 0.3 WHEN {_SEEN} IS NULL THEN 0.5 WHEN {_DAYS} < 1 THEN 1.0 WHEN {_DAYS} < 7 THEN 0.9 WHEN {_DAYS} < 30 THEN 0.7 WHEN {_DAYS} < 90 THEN 0.5 ELSE 0.2 END::DOUBLE"
_ABSTRACT = "regexp_replace(regexp_replace(hostname, '\\d+', '#', 'g'), '[a-f0-9]{8,}', 'HEX', 'g')"
_COMPLETE = " + ".join(f"{H.sql_present(f)}::INT" for f in K.REQUIRED_FIELDS)
_ENVS = ", ".join(f"'{e}'" for e in [*(x for x, _ in K.ENVIRONMENTS), "sandbox", "unknown"])
_DIMENSIONS = f"""dims AS (SELECT completeness, (naming + ip + env) / 3 AS consistency, uniqueness, validity, timeliness, (CASE WHEN d < 0.05 THEN d * 20 WHEN d > 0.2 THEN 1 - (d - 0.2::DOUBLE) * 2 ELSE 1 END + coalesce(c, 0)) / 2 AS relationships FROM
  (SELECT avg(({_COMPLETE})::DOUBLE / 6) AS completeness, coalesce(avg(CASE WHEN ip_address IS NOT NULL THEN 1.0::DOUBLE END), 0.5) AS ip, (count(DISTINCT environment) FILTER (environment IN ({_ENVS})))::DOUBLE / count(DISTINCT environment) AS env,
   count(DISTINCT hostname)::DOUBLE / count(*) AS uniqueness, avg({_VALID_ROW}) AS validity, avg({_AGE}) AS timeliness, count(*) AS n FROM hosts),
  (SELECT least(max(k)::DOUBLE / sum(k) * 2, 1) AS naming FROM (SELECT count(*) AS k FROM hosts GROUP BY {_ABSTRACT})),
  (SELECT m / (n * (n - 1) / 2.0::DOUBLE) AS d, c FROM (SELECT count(*) AS m, avg(confidence) AS c FROM edges), (SELECT count(*) AS n FROM hosts)))"""
_SIX = ["completeness", "consistency", "uniqueness", "validity", "timeliness", "relationships"]


def dims(spark, sf):
    hosts = cut(V.hosts(spark, sf))
    return Q.dimensions(hosts, R.named_edges(hosts), NOW)


@query("q1_completeness", V.with_(V.HOSTS_SQL) + f"SELECT hostname, ({_COMPLETE}) AS fields FROM hosts")
def completeness(spark, sf):
    return V.hosts(spark, sf).select("hostname", sum((F.when(H.present(F.col(f)), 1).otherwise(0) for f in K.REQUIRED_FIELDS), F.lit(0)).alias("fields"))


@query("q2_q7_dimensions", V.with_(EDGES_SQL, _DIMENSIONS) + "SELECT " + ", ".join(f"round({d}, 9) AS {d}" for d in _SIX) + ", round((" + " + ".join(_SIX) + ") / 6, 9) AS overall FROM dims")
def dimension_scores(spark, sf):
    return dims(spark, sf).select(*(F.round(c, 9).alias(c) for c in [*_SIX, "overall"]))


@query("q4_validity", V.with_(V.HOSTS_SQL) + f"SELECT hostname, round({_VALID_ROW}, 9) AS validity FROM hosts")
def validity(spark, sf):
    return V.hosts(spark, sf).select("hostname", F.round(Q.validity(), 9).alias("validity"))


@query("q5_timeliness", V.with_(V.HOSTS_SQL) + f"SELECT hostname, {_AGE} AS timeliness FROM hosts")
def timeliness(spark, sf):
    return V.hosts(spark, sf).select("hostname", Q.timeliness(F.col("last_seen"), NOW).alias("timeliness"))


FIELDS = ["hostname", "ip_address", "environment", "datacenter", "application", "owner", "os_type", "cpu_cores", "memory_gb", "last_seen"]


@query("q8_coverage", V.with_(V.HOSTS_SQL) + " UNION ALL ".join(f"SELECT '{f}' AS field, round(avg(CASE WHEN {H.sql_present(f'CAST({f} AS VARCHAR)')} THEN 100.0::DOUBLE ELSE 0 END), 9) AS percent FROM hosts" for f in FIELDS))
def coverage(spark, sf):
    return Q.coverage(V.hosts(spark, sf), FIELDS).select("field", F.round("percent", 9).alias("percent"))


_DIST = ["environment", "datacenter", "application", "host_type"]


@query("q9_distributions", V.with_(V.HOSTS_SQL) + " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce({f}, 'unknown') AS value, count(*) AS n FROM hosts GROUP BY 2" for f in _DIST))
def distributions(spark, sf):
    return Q.distributions(V.hosts(spark, sf), _DIST)


@query("q10_naming_patterns", V.with_(V.HOSTS_SQL) + f"SELECT {_ABSTRACT} AS pattern, count(*) AS n FROM hosts GROUP BY 1 ORDER BY n DESC, pattern LIMIT 5")
def naming_patterns(spark, sf):
    return Q.naming_patterns(V.hosts(spark, sf))


@query("q11_ip_consistency", V.with_(V.RAW_SQL) + f"SELECT round(avg(CASE WHEN {H.sql_valid_ip('ip_address')} THEN 1.0::DOUBLE ELSE 0 END), 9) AS share FROM host_raw WHERE ip_address IS NOT NULL")
def ip_consistency(spark, sf):
    return V.raw(spark, sf).filter("ip_address is not null").agg(F.round(F.avg(F.when(H.four_octets(F.col("ip_address")), 1.0).otherwise(0.0)), 9).alias("share"))


_CRITICAL = ["environment", "owner", "application", "datacenter"]


@query("q12_recommendations", V.with_(EDGES_SQL, _DIMENSIONS) + " UNION ALL ".join([*(f"SELECT {k} AS place, '{t}' AS text FROM dims WHERE {d} < 0.5" for k, (d, t) in enumerate(K.RECOMMENDATIONS.items())), *(f"SELECT {11 + k}, printf('Improve {f} identification - only %.1f%% coverage', p) FROM (SELECT avg(CASE WHEN {H.sql_present(f)} THEN 100.0::DOUBLE ELSE 0 END) AS p FROM hosts) WHERE p < 50" for k, f in enumerate(_CRITICAL))]))
def recommendations(spark, sf):
    return Q.recommendations(dims(spark, sf), Q.coverage(V.hosts(spark, sf), FIELDS))


# Anomalies: raw rows as entities where repeats matter
_NAMED = f"named AS (SELECT lower(host_name) AS hostname, ip_address FROM host_raw WHERE {H.sql_valid_hostname('host_name')})"


def _dup(c, name, severity, text):
    return f"SELECT '{name}' AS type, '{severity}' AS severity, {c} AS affected, printf('{text}', {c}, n) AS description FROM (SELECT {c}, count(*) AS n FROM named WHERE {c} <> '' GROUP BY 1 HAVING count(*) > 1 ORDER BY {c} LIMIT 10)"


@query("a1_duplicates", V.with_(V.RAW_SQL, _NAMED) + _dup("hostname", "duplicate_hostname", "high", "Hostname ''%s'' appears %d times") + " UNION ALL " + _dup("ip_address", "duplicate_ip", "medium", "IP address ''%s'' assigned to %d entities"))
def duplicates(spark, sf):
    named = V.raw(spark, sf).filter(H.valid_hostname(F.col("host_name"))).select(F.lower("host_name").alias("hostname"), "ip_address")
    return Q.duplicates(named, "hostname", "high", "Hostname '%s' appears %d times").unionByName(Q.duplicates(named, "ip_address", "medium", "IP address '%s' assigned to %d entities"))


_TOP3 = f"top3 AS (SELECT {_ABSTRACT} AS p, count(*) AS n FROM hosts GROUP BY 1 ORDER BY n DESC, p LIMIT 3)"


def _violations(c):
    return f"SELECT 'naming_violation' AS type, 'low' AS severity, hostname AS affected, printf('Hostname ''%s'' doesn''t match common patterns', hostname) AS description FROM (SELECT hostname FROM hosts ORDER BY hostname LIMIT 100) WHERE NOT EXISTS (SELECT 1 FROM top3 WHERE starts_with({c}, p)) ORDER BY hostname LIMIT 10"


@query("a2_naming_violations", V.with_(V.HOSTS_SQL, _TOP3) + _violations("hostname"))
def naming_violations(spark, sf):
    return Q.naming_violations(V.hosts(spark, sf))


@query("a2_naming_violations_abstracted", V.with_(V.HOSTS_SQL, _TOP3) + _violations(_ABSTRACT))
def naming_violations_abstracted(spark, sf):
    return Q.naming_violations(V.hosts(spark, sf), literal=False)


_RESOURCES = """SELECT type, 'medium' AS severity, affected, description FROM (
SELECT 0 AS family, hostname AS affected, 'resource_outlier' AS type, printf('Unusual CPU allocation: %d cores (avg: %.1f)', cpu_cores, mean) AS description FROM hosts, (SELECT avg(cpu_cores) AS mean, stddev_samp(cpu_cores) AS sd FROM hosts WHERE cpu_cores <> 0) WHERE cpu_cores <> 0 AND sd > 0 AND abs((cpu_cores - mean) / sd) > 3
UNION ALL SELECT 1, hostname, 'over_provisioned', printf('%s environment with high resources: %d CPU, %dGB RAM', upper(environment[1]) || environment[2:], coalesce(cpu_cores, 0), coalesce(memory_gb, 0)) FROM hosts WHERE environment IN ('development', 'testing', 'sandbox') AND (cpu_cores > 16 OR memory_gb > 64)
ORDER BY family, affected LIMIT 20)"""


@query("a3_resource_anomalies", V.with_(V.HOSTS_SQL) + _RESOURCES)
def resource_anomalies(spark, sf):
    return Q.resource_anomalies(V.hosts(spark, sf))


_ALONE = "alone AS (SELECT hostname FROM hosts WHERE hostname NOT IN (SELECT source FROM edges UNION SELECT target FROM edges)), rates AS (SELECT (SELECT count(*) FROM alone) AS k, (SELECT count(*) FROM hosts) AS n)"
_ORPHANS = """SELECT 'high_orphan_rate' AS type, 'high' AS severity, '' AS affected, printf('%d entities (%.1f%%) have no relationships', k, k * 100.0::DOUBLE / n) AS description FROM rates WHERE k > n * 0.3
UNION ALL SELECT 'orphaned_entity', 'low', hostname, printf('Entity ''%s'' has no relationships', hostname) FROM (SELECT hostname FROM alone ORDER BY hostname LIMIT 10), rates WHERE k <= n * 0.3"""


@query("a4_orphans", V.with_(EDGES_SQL, _ALONE) + _ORPHANS)
def orphan_anomalies(spark, sf):
    hosts = cut(V.hosts(spark, sf))
    return Q.orphan_anomalies(hosts, R.named_edges(hosts))


_DRIFT = f"""SELECT type, 'medium' AS severity, affected, description FROM (SELECT affected, 'configuration_drift' AS type, printf('Inconsistent OS types in %s: %s', affected, os) AS description FROM drifted WHERE contains(os, ',')
UNION ALL SELECT affected, 'resource_imbalance', printf('Large CPU variance in %s: %d-%d cores', affected, low, high) FROM drifted WHERE high > low * 4 ORDER BY affected, type LIMIT 15)"""
_DRIFTED = f"drifted AS (SELECT application || ':' || environment AS affected, string_agg(DISTINCT coalesce(os_type, 'unknown'), ', ' ORDER BY coalesce(os_type, 'unknown')) AS os, min(cpu_cores) FILTER (cpu_cores <> 0) AS low, max(cpu_cores) AS high FROM hosts WHERE {H.sql_present('application')} AND {H.sql_present('environment')} GROUP BY 1 HAVING count(*) > 1)"


@query("a5_drift", V.with_(V.HOSTS_SQL, _DRIFTED) + _DRIFT)
def drift(spark, sf):
    return Q.drift(V.hosts(spark, sf))


_MISSING = "SELECT 'missing_field' AS type, CASE WHEN m > 50 THEN 'high' ELSE 'medium' END AS severity, f AS affected, printf('Field ''%s'' missing in %.1f%% of entities', f, m) AS description FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS f, 100 - avg(CASE WHEN {H.sql_present(f)} THEN 100.0::DOUBLE ELSE 0 END) AS m FROM hosts" for f in K.REQUIRED_FIELDS) + ") WHERE m > 20"


@query("a6_missing_fields", V.with_(V.HOSTS_SQL) + _MISSING)
def missing_fields(spark, sf):
    return Q.missing_fields(V.hosts(spark, sf))


_TESTS = f"SELECT 'test_in_production' AS type, 'high' AS severity, hostname AS affected, printf('Possible test entity in production: %s', hostname) AS description FROM (SELECT hostname FROM hosts WHERE environment = 'production' AND ({' OR '.join(f'contains(hostname, {w!r})' for w in K.TEST_WORDS)}) ORDER BY hostname LIMIT 10)"


@query("a7_test_in_production", V.with_(V.HOSTS_SQL) + _TESTS)
def test_in_production(spark, sf):
    return Q.test_in_production(V.hosts(spark, sf))


_HOST_NAMED = "named AS (SELECT hostname, ip_address FROM hosts)"


@query("a8_anomalies", V.with_(EDGES_SQL, _HOST_NAMED, _TOP3, _ALONE, _DRIFTED) + " UNION ALL ".join(f"(SELECT * FROM ({q}))" for q in (_dup("hostname", "duplicate_hostname", "high", "Hostname ''%s'' appears %d times"), _dup("ip_address", "duplicate_ip", "medium", "IP address ''%s'' assigned to %d entities"), _violations("hostname"), _RESOURCES, _ORPHANS, _DRIFT, _MISSING, _TESTS)))
def anomalies(spark, sf):
    hosts = cut(V.hosts(spark, sf))
    return Q.anomalies(hosts, R.named_edges(hosts))


_FIGURES = f"""figures AS (SELECT count(*) AS n, count(*) FILTER (environment = 'production') AS prod, count(*) FILTER (coalesce(application, 'unknown') = 'unknown') AS no_app, count(DISTINCT datacenter) AS dcs, count(DISTINCT coalesce(os_type, 'unknown')) AS systems,
  count(*) FILTER (type = 'physical_server') AS ps, count(*) FILTER (type = 'virtual_machine') AS vm, count(*) FILTER (type = 'container') AS ct,
  count(*) FILTER (environment IN ('development', 'testing') AND (coalesce(cpu_cores, 0) > 8 OR coalesce(memory_gb, 0) > 32)) AS costly, count(*) FILTER (ip_address <> '' AND NOT (starts_with(ip_address, '10.') OR starts_with(ip_address, '172.') OR starts_with(ip_address, '192.168.'))) AS public,
  count(*) FILTER (NOT {H.sql_present('owner')}) AS no_owner, count(*) FILTER (coalesce(status, '') <> 'active') AS inactive, count(nullif(cpu_cores, 0)) AS with_cpu, sum(cpu_cores)::BIGINT AS cpu, avg(nullif(cpu_cores, 0)) AS avg_cpu, max(cpu_cores) AS max_cpu, count(nullif(memory_gb, 0)) AS with_memory, sum(memory_gb)::BIGINT AS memory,
  (SELECT count(*) FROM edges) AS m, (SELECT count(*) FROM edges WHERE type = 'same_application') AS apps, (SELECT string_agg(e, ', ' ORDER BY e) FROM (VALUES ('development'), ('production'), ('staging')) v(e) WHERE e NOT IN (SELECT environment FROM hosts)) AS missing FROM hosts JOIN typed USING (hostname))"""
_INSIGHTS = [
    ("environment", "prod > 0 AND n > prod AND (n - prod) / prod < 0.5", "low_ratio", ["(n - prod) / prod"]),
    ("environment", "prod > 0 AND (n - prod) / prod > 3", "high_ratio", ["(n - prod) / prod"]),
    ("environment", "missing <> ''", "missing", ["missing"]),
    ("application", "no_app > n * 0.2", "no_application", ["no_app"]),
    ("infrastructure", "dcs = 1", "one_place", []),
    ("infrastructure", "dcs > 5", "many_places", ["dcs"]),
    ("infrastructure", "systems > 3", "systems", ["systems"]),
    ("infrastructure", "ps > vm + ct", "physical", []),
    ("infrastructure", "ct > vm * 2 AND ps <= vm + ct", "containers", []),
    ("relationship", "m = 0", "no_links", []),
    ("relationship", "m > 0 AND m / (n * (n - 1) / 2) < 0.01", "few_links", []),
    ("relationship", "m / (n * (n - 1) / 2) > 0.3", "many_links", []),
    ("relationship", "apps > m * 0.5", "clustering", []),
    ("cost", "costly > 0", "costly", ["costly"]),
    ("cost", "inactive > n * 0.1", "inactive", ["inactive"]),
    ("security", "public > 0", "public", ["public"]),
    ("security", "no_owner > n * 0.2", "no_owner", ["no_owner"]),
    ("capacity", "with_cpu > 0", "cpu", ["cpu", "with_cpu", "avg_cpu"]),
    ("capacity", "max_cpu > avg_cpu * 5", "cpu_variance", []),
    ("capacity", "with_memory > 0", "memory", ["memory", "with_memory"]),
]


def _said(key, values):
    """The text as DuckDB says it, whose printf marks thousands another way."""
    text = K.INSIGHTS[key].replace("'", "''")
    if "%,d" in text:
        return f"format('{text.replace('%,d', '{:,}').replace('%d', '{}')}', {', '.join(values)})"
    return f"printf('{text}', {', '.join(values)})" if values else f"'{text}'"


@query("i1_i8_insights", V.with_(CLASSES_SQL, EDGES_SQL.removeprefix(V.HOSTS_SQL + ",\n"), _FIGURES) + " UNION ALL ".join([*(f"SELECT '{t}' AS topic, {_said(k, v)} AS insight FROM figures WHERE {w}" for t, w, k, v in _INSIGHTS), f"SELECT 'application', {_said('one_application', ['app', 'k * 100.0::DOUBLE / n'])} FROM (SELECT coalesce(application, 'unknown') AS app, count(*) AS k FROM hosts GROUP BY 1 ORDER BY k DESC, app LIMIT 3), figures WHERE k * 100.0 / n > 30"]))
def insights(spark, sf):
    hosts, picked = once(spark, sf)
    types = C.entity_type(hosts, picked).select("hostname", "type")
    return Q.insights(cut(hosts.join(types, "hostname")), R.named_edges(hosts))


_LIMITS = [
    ("naming_convention", "NOT (" + " OR ".join(f"regexp_matches(hostname, '{p}')" for p in K.NAMING_CONVENTIONS) + ")"),
    ("ip_range", "NOT (" + " OR ".join(f"regexp_matches(ip_address, '{p}')" for p, _ in K.PRIVATE_RANGES) + ")"),
    *((c, f"{c} NOT BETWEEN {low} AND {high}") for c, (low, high) in K.RESOURCE_LIMITS.items() if c != "disk_gb"),
    ("age", f"{_DAYS} NOT BETWEEN {K.AGE_LIMITS[0]} AND {K.AGE_LIMITS[1]}"),
]


@query("a9_out_of_limits", V.with_(V.HOSTS_SQL) + " UNION ALL ".join(f"SELECT hostname, '{n}' AS rule FROM hosts WHERE {w}" for n, w in _LIMITS))
def out_of_limits(spark, sf):
    return Q.out_of_limits(V.hosts(spark, sf), NOW)


_D = ", ".join(f"count(DISTINCT coalesce({c}, '')) AS {a}" for c, a in (("environment", "environments"), ("datacenter", "datacenters"), ("application", "applications"), ("os_type", "os_types")))


@query("g0_statistics", V.with_(EDGES_SQL) + f"SELECT count(*) AS entities, {_D}, round(({' + '.join(f'''sum((coalesce({c}, '') <> 'unknown')::INT)''' for c in ('environment', 'application', 'owner'))}) / (3 * count(*)), 9) AS accuracy, round(avg(confidence), 9) AS confidence, (SELECT count(*) FROM edges) AS relationships, (SELECT round(avg(confidence), 9) FROM edges) AS relationship_confidence FROM hosts")
def statistics(spark, sf):
    s = Q.statistics(V.hosts(spark, sf), edges(spark, sf))
    return s.withColumns({c: F.round(c, 9) for c in ("accuracy", "confidence", "relationship_confidence")})


@query("g00_store_statistics", V.with_(EDGES_SQL) + "SELECT count(*) AS total, count(*) FILTER (confidence > 0.8) AS confident, (SELECT count(*) FROM edges) AS relationships, round(avg(quality_score), 9) AS quality FROM hosts")
def store_statistics(spark, sf):
    hosts = V.hosts(spark, sf).agg(F.count("*").alias("total"), F.count_if(F.col("confidence") > 0.8).alias("confident"), F.round(F.avg("quality_score"), 9).alias("quality"))
    return hosts.crossJoin(edges(spark, sf).agg(F.count("*").alias("relationships")))
