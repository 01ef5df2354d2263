"""Queries: stores, exports, stages and scans of files, each written whole to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import scan as S
from ..operators.lineage import folder
from ..sources import files, sinks
from ..sources.inventory import table
from . import views as V
from .inventory import sql
from .registry import query
from .relate_queries import EDGES_SQL, edges


def stored(spark, sf):
    """A store of hosts, of which those in production are active, and of relationships."""
    path = folder(spark)
    hosts = V.hosts(spark, sf).select("hostname", "environment", F.round("quality_score", 9).alias("quality_score"), (F.col("environment") == "production").alias("is_active"))
    sinks.store({"hosts": hosts, "relationships": edges(spark, sf).select("source", "target", "type", "confidence")}, path)
    return sinks.load(spark, path, ["hosts", "relationships"])


@query("k1_s21_active_hosts", V.with_(V.HOSTS_SQL) + "SELECT hostname, environment, round(quality_score, 9) AS quality_score FROM hosts WHERE environment = 'production'")
def active_hosts(spark, sf):
    return stored(spark, sf)["hosts"].drop("is_active")


@query("k6_stored_relationships", V.with_(EDGES_SQL) + "SELECT source, target, type, confidence FROM edges")
def stored_relationships(spark, sf):
    return stored(spark, sf)["relationships"]


_LISTED = "SELECT hostname, environment, [datacenter, host_type] AS places, CAST(n_sources AS BIGINT) AS n_sources FROM hosts"


def listed(spark, sf):
    return V.hosts(spark, sf).select("hostname", "environment", F.array("datacenter", "host_type").alias("places"), "n_sources")


def exported(spark, sf, form):
    path = folder(spark)
    sinks.export(listed(spark, sf), path, form)
    return path


@query("k8_parquet_export", V.with_(V.HOSTS_SQL) + _LISTED)
def parquet_export(spark, sf):
    return spark.read.parquet(exported(spark, sf, "parquet"))


@query("k9_s16_csv_export", V.with_(V.HOSTS_SQL) + f"SELECT hostname, environment, '[\"' || places[1] || '\",\"' || places[2] || '\"]' AS places, n_sources FROM ({_LISTED})")
def csv_export(spark, sf):
    """Lists go out as JSON."""
    return files.read_csv(spark, exported(spark, sf, "csv"), "hostname string, environment string, places string, n_sources long").withColumn("places", F.regexp_replace("places", r'\\"', '"'))


@query("k10_s20_json_export", V.with_(V.HOSTS_SQL) + _LISTED)
def json_export(spark, sf):
    return files.read_json(spark, exported(spark, sf, "json"), "hostname string, environment string, places array<string>, n_sources long")


@query("s16_csv_scan", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders GROUP BY 1, 2")
def csv_scan(spark, sf):
    path = folder(spark)
    sinks.export(table(spark, sf, "orders").drop("o_orderdate"), path, "csv")
    rows = files.read_csv(spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    return rows.groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


@query("k13_stages", V.with_(V.HOSTS_SQL) + "SELECT hostname, host_type FROM hosts")
def stages(spark, sf):
    """A stage that was saved, as another run finds it."""
    path = folder(spark)
    sinks.save_stage(V.hosts(spark, sf).select("hostname", "host_type"), path, "hosts")
    return sinks.load_stage(spark, path, "hosts")


@query("k7_ad_hoc_sql", V.with_(V.HOSTS_SQL) + "SELECT environment, count(*) AS n, min(hostname) AS least FROM hosts GROUP BY 1")
def ad_hoc(spark, sf):
    name = f"hosts_{uuid.uuid4().hex}"
    return sql(spark, {name: V.hosts(spark, sf)}, f"SELECT environment, count(*) AS n, min(hostname) AS least FROM {name} GROUP BY environment")


@query("s2_scan_ladder", "SELECT 'by_columns' AS strategy, l_returnflag, count(*) AS n FROM lineitem GROUP BY 2")
def scan_ladder(spark, sf):
    """Of three ways to read a table the first fails and the second finds nothing."""

    def by_other_name():
        return table(spark, sf, "no_such_table")

    def sampled():
        return S.sampled(table(spark, sf, "lineitem").filter("l_orderkey < 0"), 10, 100)

    def by_columns():
        return table(spark, sf, "lineitem").select("l_returnflag")

    rows, strategy = S.scan([by_other_name, sampled, by_columns])
    return rows.groupBy(F.lit(strategy).alias("strategy"), "l_returnflag").agg(F.count("*").alias("n"))
