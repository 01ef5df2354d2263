"""Queries: enrichment and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import host as H
from ..operators import classify as C
from ..operators import discovery as D
from ..operators.lineage import cut
from . import views as V
from .registry import query

ATTRIBUTE_TYPES = {"last_seen": "timestamp", "cpu_cores": "numeric", "memory_gb": "numeric"}
_BASE = (V.HOSTS_SQL, V.ATTRIBUTES_SQL)
_FIRST = "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hostname, attribute ORDER BY table_name, row_id) AS place FROM attributes) WHERE place <= 5)"
_SCORES = """scores AS (SELECT hostname, count(*) AS occurrences,
  least(max(confidence) * 0.4::DOUBLE + avg(confidence) * 0.3::DOUBLE + least(count(*) / 10, 1) * 0.2::DOUBLE + least(count(DISTINCT table_name) / 5, 1) * 0.1::DOUBLE, 1) AS confidence,
  least(least(count(*) / 5, 0.5::DOUBLE) + avg(confidence) * 0.5::DOUBLE + least(count(DISTINCT table_name) / 3, 0.3::DOUBLE), 1) AS source_confidence FROM picked GROUP BY 1)"""


def _hits(c, words):
    return "(" + " + ".join(f"contains({c}, '{w}')::INT" for w in words) + ")"


def _any(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_N = range(len(K.ENTITY_TYPES))
_SCORE = [f"least(round(CASE WHEN regexp_matches(h.hostname, '{'|'.join(p)}') THEN 0.4::DOUBLE ELSE 0 END + {_hits('h.hostname', w)} * 0.2::DOUBLE + coalesce(a{k}, 0) * 0.1::DOUBLE + {b}::DOUBLE, 9), 1)" for k, (_, p, w, b) in enumerate(K.ENTITY_TYPES)]
_TYPES = f"""
held AS (SELECT hostname, {", ".join(f"sum(v{k} + {_hits('lower(attribute)', w)}) AS a{k}" for k, (_, _, w, _) in enumerate(K.ENTITY_TYPES))} FROM
  (SELECT hostname, attribute, {", ".join(f"sum({_any('lower(value)', w)}::INT) AS v{k}" for k, (_, _, w, _) in enumerate(K.ENTITY_TYPES))} FROM firsts GROUP BY 1, 2) GROUP BY 1),
scored AS (SELECT h.hostname, {", ".join(f"{s} AS s{k}" for k, s in enumerate(_SCORE))} FROM hosts h LEFT JOIN held USING (hostname)),
typed AS (SELECT hostname, CASE greatest({", ".join(f"s{k}" for k in _N)}) {" ".join(f"WHEN s{k} THEN '{K.ENTITY_TYPES[k][0]}'" for k in _N)} END AS type, greatest({", ".join(f"s{k}" for k in _N)}) AS type_confidence FROM scored)"""


def _place(c):
    return "CASE " + " ".join(f"WHEN {_any(c, w)} THEN {k}" for k, (_, w) in enumerate(K.SUB_TYPES)) + " ELSE 99 END"


_SUB = f"""subs AS (SELECT h.hostname, coalesce(CASE least({_place('h.hostname')}, coalesce(place, 99)) {" ".join(f"WHEN {k} THEN '{n}'" for k, (n, _) in enumerate(K.SUB_TYPES))} END, {H.sql_first_keyword('h.hostname', K.LAST_SUB_TYPES)}, 'general_purpose') AS sub_type
  FROM hosts h LEFT JOIN (SELECT hostname, min(least({_place('lower(value)')}, {_place('lower(attribute)')})) AS place FROM firsts GROUP BY 1) USING (hostname))"""
_ATTR = f"attrs AS (SELECT hostname, least(count(*) FILTER ({_any('lower(attribute)', K.IMPORTANT_ATTRIBUTES)}) / 6 + least(count(*) / 20, 0.3::DOUBLE), 1) AS attribute_confidence FROM (SELECT DISTINCT hostname, attribute FROM attributes) GROUP BY 1)"
_CLASSES = """classes AS (SELECT hostname, type, sub_type, least((type_confidence + coalesce(attribute_confidence, 0.3::DOUBLE) + source_confidence) / 3, 1) AS confidence,
  CASE WHEN type_confidence > 0.8 THEN 'pattern_matching' WHEN round(coalesce(attribute_confidence, 0.3), 9) > 0.7 THEN 'attribute_analysis' WHEN round(source_confidence, 9) > 0.6 THEN 'source_correlation' ELSE 'heuristic' END AS method
  FROM typed JOIN subs USING (hostname) LEFT JOIN attrs USING (hostname) JOIN scores USING (hostname))"""
CLASSES_SQL = ",\n".join((*_BASE, _FIRST, _SCORES, _TYPES, _SUB, _ATTR, _CLASSES))


def once(spark, sf):
    """Picked rows and hosts, found once for plans that read them many times."""
    picked = cut(V.picked(spark, sf))
    return cut(D.enrich(D.group_hosts(picked))), picked


def classes(spark, sf):
    return C.classify(*once(spark, sf))


_INFERRED = f"""inferred_names AS (SELECT hostname, {H.sql_first_keyword('hostname', K.INFERRED_ENVIRONMENTS)} AS environment_inferred, {H.sql_first_keyword('hostname', K.INFERRED_REGIONS)} AS datacenter_inferred,
  coalesce({H.sql_first_keyword('hostname', K.INFERRED_SYSTEMS)}, CASE WHEN contains(lower(os_type), 'windows') THEN 'windows' WHEN {_any('lower(os_type)', ['linux', 'ubuntu', 'centos'])} THEN 'linux' END) AS os_inferred,
  CASE WHEN regexp_matches(hostname, '{K.IPV4}') THEN array_to_string(string_split(hostname, '.')[1:3], '.') || '.0/24' END AS network_segment FROM hosts)"""


@query("n2_latest_values", V.with_(*_BASE) + """SELECT hostname, attribute, CASE WHEN count(*) = 1 THEN arg_min(value, k) ELSE CAST(median(try_cast(value AS DOUBLE)) AS VARCHAR) END AS value
FROM (SELECT hostname, attribute, lower(value), arg_min(value, (table_name, row_id)) AS value, min((table_name, row_id)) AS k FROM attributes WHERE attribute IN ('cpu_cores', 'memory_gb') GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def latest_values(spark, sf):
    return C.reduce_attributes(V.picked(spark, sf), ATTRIBUTE_TYPES).filter("attribute in ('cpu_cores', 'memory_gb')")


@query("n2_reduced_attributes", V.with_(*_BASE) + """SELECT hostname, attribute, CASE WHEN count(*) = 1 THEN min(value) WHEN attribute = 'last_seen' THEN list(value ORDER BY try_cast(value AS TIMESTAMP) DESC NULLS LAST, k, folded)[1]
  WHEN attribute IN ('cpu_cores', 'memory_gb') THEN coalesce(CAST(median(try_cast(value AS DOUBLE)) AS VARCHAR), list(value ORDER BY k, folded)[1]) ELSE array_to_string(list(value ORDER BY k, folded), ',') END AS value
FROM (SELECT hostname, attribute, lower(value) AS folded, arg_min(value, (table_name, row_id, value)) AS value, min((table_name, row_id)) AS k FROM attributes GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def reduced(spark, sf):
    return C.reduce_attributes(V.picked(spark, sf), ATTRIBUTE_TYPES)


@query("n3_confidence", V.with_(V.PICKED_SQL, _SCORES) + "SELECT hostname, occurrences, round(confidence, 9) AS confidence, round(source_confidence, 9) AS source_confidence FROM scores")
def confidence(spark, sf):
    return C.source_scores(V.picked(spark, sf)).select("hostname", "occurrences", F.round("confidence", 9).alias("confidence"), F.round("source_confidence", 9).alias("source_confidence"))


_WEIGHTS = {"hostname": "hostname", "environment": "coalesce(given_environment, environment_inferred)", "datacenter": "datacenter_inferred", "os_type": "coalesce(os_type, os_inferred)", "owner": "owner", "application": "application"}
_HELD = " + ".join(f"CASE WHEN trim({v}) <> '' THEN {K.ENRICHMENT_WEIGHTS[f]}::DOUBLE ELSE 0 END" for f, v in _WEIGHTS.items())


@query("n4_enriched_quality", V.with_(V.HOSTS_SQL, _SCORES, _INFERRED) + f"SELECT hostname, round(({_HELD}) / {sum(K.ENRICHMENT_WEIGHTS.values())}::DOUBLE * 0.5::DOUBLE + s.confidence * 0.3::DOUBLE + least(occurrences / 10, 1) * 0.2::DOUBLE, 9) AS quality_score FROM hosts JOIN inferred_names USING (hostname) JOIN scores s USING (hostname)")
def enriched_quality(spark, sf):
    return C.enriched_quality(V.hosts(spark, sf), C.source_scores(V.picked(spark, sf))).select("hostname", F.round("quality_score", 9).alias("quality_score"))


@query("n5_n8_inferred", V.with_(V.HOSTS_SQL, _INFERRED) + "SELECT * FROM inferred_names")
def inferred(spark, sf):
    return C.inferred(V.hosts(spark, sf))


@query("n9_entity_type", V.with_(*_BASE, _FIRST, _TYPES) + "SELECT * FROM typed")
def entity_type(spark, sf):
    return C.entity_type(V.hosts(spark, sf), V.picked(spark, sf))


@query("n10_sub_type", V.with_(*_BASE, _FIRST, _SUB) + "SELECT * FROM subs")
def sub_type(spark, sf):
    return C.sub_type(V.hosts(spark, sf), V.picked(spark, sf))


@query("n11_attribute_confidence", V.with_(*_BASE, _ATTR) + "SELECT hostname, round(attribute_confidence, 9) AS attribute_confidence FROM attrs")
def attribute_confidence(spark, sf):
    return C.attribute_confidence(V.picked(spark, sf)).select("hostname", F.round("attribute_confidence", 9).alias("attribute_confidence"))


@query("n12_n13_classification", V.with_(CLASSES_SQL) + "SELECT hostname, type, sub_type, round(confidence, 9) AS confidence, method FROM classes")
def classification(spark, sf):
    return classes(spark, sf).withColumn("confidence", F.round("confidence", 9))


_TAGS = ", ".join(
    ["type", "sub_type", *(f"CASE WHEN {H.sql_present(c)} THEN '{p}' || {c} END" for c, p in (("environment", "env:"), ("datacenter", "dc:"), ("os_type", "os:"), ("application", "app:"), ("owner", "owner:")))]
    + [
        f"CASE WHEN {_any('hostname', ['test', 'qa'])} THEN 'non-production' WHEN {_any('hostname', ['prod', 'prd'])} THEN 'production' END",
        f"CASE WHEN {_any('hostname', ['backup', 'bkp'])} THEN 'backup' END",
        "CASE WHEN contains(hostname, 'dr') THEN 'disaster-recovery' END",
        "CASE WHEN contains(hostname, 'dev') THEN 'development' END",
        f"CASE WHEN {_any('hostname', ['temp', 'tmp'])} THEN 'temporary' END",
        f"CASE WHEN regexp_matches(hostname, '^i-[a-f0-9]{{8,}}') THEN 'aws' WHEN contains(hostname, 'azure') THEN 'azure' WHEN {_any('hostname', ['gcp', 'gce'])} THEN 'gcp' END",
    ]
)


@query("n14_tags", V.with_(CLASSES_SQL) + f"SELECT hostname, concat_ws(' ', {_TAGS}) AS tags FROM hosts JOIN classes USING (hostname)")
def tags(spark, sf):
    hosts, picked = once(spark, sf)
    return C.tags(hosts, C.classify(hosts, picked)).select("hostname", F.array_join("tags", " ").alias("tags"))


def _points(c, table):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 0 END"


_CRITICAL = f"""critical AS (SELECT hostname, {_points('environment', K.CRITICALITY_ENVIRONMENT)} + {_points('application', K.CRITICALITY_APPLICATION)} + CASE WHEN c.confidence > 0.9 THEN 10 ELSE 0 END + CASE WHEN n_sources > 5 THEN 20 WHEN n_sources > 2 THEN 10 ELSE 0 END AS points FROM hosts JOIN classes c USING (hostname))"""


@query("n15_criticality", V.with_(CLASSES_SQL, _CRITICAL) + "SELECT hostname, points, CASE WHEN points >= 70 THEN 'critical' WHEN points >= 50 THEN 'high' WHEN points >= 30 THEN 'medium' ELSE 'low' END AS criticality FROM critical")
def criticality(spark, sf):
    hosts, picked = once(spark, sf)
    return C.criticality(hosts, C.classify(hosts, picked))


@query("n1_n16_enriched_hosts", V.with_(CLASSES_SQL) + "SELECT hostname, environment, datacenter, application, type, sub_type, method, occurrences FROM hosts JOIN classes USING (hostname) JOIN scores USING (hostname)")
def enriched(spark, sf):
    hosts, picked = once(spark, sf)
    scores = C.source_scores(picked).select("hostname", "occurrences")
    return hosts.join(C.classify(hosts, picked).drop("confidence"), "hostname").join(scores, "hostname").select("hostname", "environment", "datacenter", "application", "type", "sub_type", "method", "occurrences")
