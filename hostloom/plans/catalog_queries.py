"""Queries: discovery over all tables of the folder, with no column named in advance. The SQL takes the tables apart into rows of column and value."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import host as H
from ..operators import catalog as C
from ..sources.inventory import DERIVED, derived
from . import views as V
from .discovery_queries import CATALOG_TABLES
from .registry import query


def sources(spark, sf):
    """The folder's tables, and those that are derived from them."""
    return C.tables(spark, sf) | derived(spark, sf)


_LONG = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, r AS row_id, column_name, value FROM (UNPIVOT (SELECT row_number() OVER () AS r, COLUMNS(*)::VARCHAR FROM {t}) ON COLUMNS(* EXCLUDE (r)) INTO NAME column_name VALUE value)" for t in [*CATALOG_TABLES, *DERIVED]
)
_ORDINALS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, row_number() OVER () AS ordinal FROM (DESCRIBE SELECT * FROM {t})" for t in [*CATALOG_TABLES, *DERIVED])


def _rules(category: str) -> str:
    return ", ".join(f"CASE WHEN regexp_full_match(lower(column_name), '{p}') THEN {c}::DOUBLE END" for p, c in K.COLUMN_RULES[category])


_LIKELY = f"({H.sql_valid_hostname('value')} AND regexp_matches(value, '^[A-Za-z].*[-.]'))"
_VIEWS = [
    *(f"{name} AS ({text.strip()})" for name, text in DERIVED.items()),
    f"long AS MATERIALIZED ({_LONG})",
    f"ordinals AS ({_ORDINALS})",
    f"profiled AS (SELECT table_name, column_name, count(*) FILTER (value <> '') AS filled, count(*) FILTER ({_LIKELY}) AS hosts, count(*) FILTER ({H.sql_valid_ip('value')}) AS addresses, count(DISTINCT value) FILTER (value <> '') AS different FROM long GROUP BY 1, 2)",
    f"""judged AS (SELECT o.*, filled, hosts, addresses,
  greatest({_rules('hostname')}, CASE WHEN hosts / filled > {C.HOST_LIKELY}::DOUBLE AND greatest({', '.join(_rules(c) for c in C.OTHERS)}) IS NULL THEN hosts / filled END) + CASE WHEN different / filled > {C.DISTINCT}::DOUBLE THEN {C.GAIN}::DOUBLE ELSE 0 END AS hostname,
  greatest({_rules('ip')}, CASE WHEN addresses / filled > {C.IP_LIKELY}::DOUBLE THEN addresses / filled END) AS ip, greatest({_rules('environment')}) AS environment, greatest({_rules('application')}) AS application
  FROM ordinals o LEFT JOIN profiled USING (table_name, column_name))""",
    "columns_found AS (SELECT table_name, column_name, ordinal, category, confidence FROM (UNPIVOT (SELECT table_name, column_name, ordinal, hostname, ip, environment, application FROM judged) ON hostname, ip, environment, application INTO NAME category VALUE confidence) WHERE confidence > 0.5 OR category IN ('environment', 'application'))",
    f"""told AS (SELECT l.table_name, l.row_id, arg_min(CASE category WHEN 'hostname' THEN lower(value) ELSE value END, (category, -confidence, ordinal)) AS hostname, arg_min(CASE category WHEN 'hostname' THEN confidence ELSE confidence * 0.7::DOUBLE END, (category, -confidence, ordinal)) AS confidence
  FROM long l JOIN columns_found USING (table_name, column_name) WHERE category = 'hostname' AND {H.sql_valid_hostname('value')} OR category = 'ip' AND {H.sql_valid_ip('value')} GROUP BY 1, 2)""",
    f"""values_told AS (SELECT t.table_name, t.row_id, t.hostname, 'ip_address' AS attribute, value FROM told t JOIN long l USING (table_name, row_id) JOIN columns_found c USING (table_name, column_name) WHERE category = 'ip' AND {H.sql_valid_ip('value')}
  UNION ALL SELECT t.table_name, t.row_id, t.hostname, category, lower(value) FROM told t JOIN long l USING (table_name, row_id) JOIN columns_found c USING (table_name, column_name) WHERE category IN ('environment', 'application') AND value <> ''
  UNION ALL SELECT t.table_name, t.row_id, t.hostname, column_name, value FROM told t JOIN long l USING (table_name, row_id) ANTI JOIN columns_found c USING (table_name, column_name))""",
]


def _with(last: str) -> str:
    return V.with_(*_VIEWS) + last


@query("s1_catalog_profile", _with("SELECT table_name, column_name, coalesce(filled, 0) AS filled, coalesce(hosts, 0) AS hosts, coalesce(addresses, 0) AS addresses FROM judged"))
def profile(spark, sf):
    return C.profile(sources(spark, sf)).drop("ordinal")


@query("d1_catalog_columns", _with("SELECT table_name, column_name, category, round(confidence, 9) AS confidence FROM columns_found"))
def columns(spark, sf):
    return C.found(sources(spark, sf)).select("table_name", "column_name", "category", F.round("confidence", 9).alias("confidence"))


@query("s1_d1_catalog_hosts", _with("SELECT hostname, count(*) AS n_sources, count(DISTINCT table_name) AS n_tables, round(max(confidence), 9) AS confidence FROM told GROUP BY 1"))
def hosts(spark, sf):
    return C.hosts(C.host_rows(sources(spark, sf))).withColumn("confidence", F.round("confidence", 9))


@query("d1_d3_catalog_attributes", _with("SELECT table_name, hostname, attribute, count(*) AS n, min(value) FILTER (attribute IN ('ip_address', 'environment', 'application')) AS least FROM values_told GROUP BY 1, 2, 3"))
def attributes(spark, sf):
    rows = C.long(C.host_rows(sources(spark, sf)))
    return rows.groupBy("table_name", "hostname", "attribute").agg(F.count("*").alias("n"), F.min(F.when(F.col("attribute").isin("ip_address", "environment", "application"), F.col("value"))).alias("least"))
