"""Views that queries share, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import constants as K
from ..functions import host as H
from ..operators import discovery as D
from ..sources.inventory import HOST_RAW, host_raw


def raw(spark: SparkSession, sf: str) -> DataFrame:
    return host_raw(spark, sf)


def picked(spark: SparkSession, sf: str) -> DataFrame:
    return D.picked(host_raw(spark, sf))


def hosts(spark: SparkSession, sf: str) -> DataFrame:
    return D.discover(host_raw(spark, sf))


RAW_SQL = f"host_raw AS ({HOST_RAW.strip()})"
PICKED_SQL = f"""{RAW_SQL},
picked AS (SELECT * FROM (SELECT r.*, CASE WHEN {H.sql_valid_hostname("host_name")} THEN lower(host_name) WHEN {H.sql_valid_ip("ip_address")} THEN ip_address END AS hostname,
  CASE WHEN {H.sql_valid_hostname("host_name")} THEN 0.95::DOUBLE ELSE 0.95::DOUBLE * 0.7::DOUBLE END AS confidence FROM host_raw r) WHERE hostname IS NOT NULL)"""


def _first(c: str, name: str) -> str:
    return f"arg_min({c}, (table_name, row_id)) FILTER (({c}) IS NOT NULL) AS {name}"


_IP = f"CASE WHEN {H.sql_valid_ip('ip_address')} THEN ip_address END"
_HELD = " + ".join(f"CASE WHEN {H.sql_present(f)} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for f, w in K.DISCOVERY_WEIGHTS.items())
HOSTS_SQL = f"""{PICKED_SQL},
grouped AS (SELECT hostname, count(*) AS n_sources, count(DISTINCT table_name) AS n_tables, max(confidence) AS confidence, min((table_name, row_id)) AS ord,
  {_first(_IP, "ip_address")}, {_first("lower(nullif(environment, ''))", "given_environment")}, {_first("lower(nullif(application, ''))", "application")},
  {", ".join(_first(a, a) for a in D.ATTRIBUTES)} FROM picked GROUP BY hostname),
inferred AS (SELECT *, coalesce(given_environment, {H.sql_first_keyword("hostname", K.ENVIRONMENTS, "'unknown'")}) AS environment, {H.sql_datacenter("hostname", "ip_address")} AS datacenter,
  {H.sql_first_keyword("hostname", K.HOST_TYPES, "'compute'")} AS host_type FROM grouped),
hosts AS (SELECT *, ({_HELD} + confidence * 0.2::DOUBLE) / 1.0::DOUBLE AS quality_score FROM inferred)"""
_PAIRS = [("ip_address", _IP), ("environment", "lower(environment)"), ("application", "lower(application)"), *((a, f"CAST({a} AS VARCHAR)") for a in D.ATTRIBUTES)]
ATTRIBUTES_SQL = "attributes AS (" + " UNION ALL ".join(f"SELECT hostname, table_name, row_id, '{n}' AS attribute, {v} AS value FROM picked WHERE ({v}) IS NOT NULL" for n, v in _PAIRS) + ")"


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"
