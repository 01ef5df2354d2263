"""From rows to hosts: picking a host name, grouping, attributes, inference, quality and duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import host as H

ATTRIBUTES = ["owner", "os_type", "cpu_cores", "memory_gb", "last_seen", "status"]


def column_confidence(name: Column, category: str, potential: Column | None = None, likelihood: Column | None = None) -> Column:
    """The highest confidence of a category's rules that fit a column's name; null if none does."""
    fits = [F.when(F.lower(name).rlike(f"^{p}$"), c) for p, c in K.COLUMN_RULES[category]]
    return F.greatest(*fits, F.lit(None).cast("double"))


def find_columns(catalog: DataFrame, category: str, above: float) -> DataFrame:
    """Rows table_name, column_name, confidence of a column catalog that a category's rules hold above a bound."""
    return catalog.select("table_name", "column_name", column_confidence(F.col("column_name"), category).alias("confidence")).filter(F.col("confidence") > above)


def picked_name(names: list[tuple[Column, float]], ips: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """The first valid host name, in lower case, else the first valid address at 0.7 of its confidence; and the confidence."""
    found = [(H.valid_hostname(c), F.lower(c), conf) for c, conf in names] + [(H.valid_ip(c), c, conf * 0.7) for c, conf in ips]
    return F.coalesce(*(F.when(ok, v) for ok, v, _ in found)), F.coalesce(*(F.when(ok, F.lit(conf)) for ok, _, conf in found))


def pick(rows: DataFrame, hostname_columns: list[tuple[str, float]], ip_columns: list[tuple[str, float]]) -> DataFrame:
    """Adds hostname and confidence: the first column by confidence with a valid name, else the first valid address at
    0.7 of its confidence. Rows without either go."""
    name, confidence = picked_name(*([(F.col(c), conf) for c, conf in cs] for cs in (hostname_columns, ip_columns)))
    return rows.withColumns({"hostname": name, "confidence": confidence}).filter("hostname is not null")


def picked(raw: DataFrame) -> DataFrame:
    return pick(raw, [("host_name", 0.95)], [("ip_address", 0.95)])


def first_seen(c: Column, order: Column) -> Column:
    return F.min_by(c, F.when(c.isNotNull(), order))


def group_hosts(rows: DataFrame) -> DataFrame:
    """One row a host: sources, tables, the highest confidence, and the first value seen of each attribute."""
    order = F.struct("table_name", "row_id")
    ip = F.when(H.valid_ip(F.col("ip_address")), F.col("ip_address"))
    given = {"ip_address": ip, "environment": F.lower(F.nullif("environment", F.lit(""))), "application": F.lower(F.nullif("application", F.lit("")))} | {a: F.col(a) for a in ATTRIBUTES}
    return rows.groupBy("hostname").agg(
        F.count("*").alias("n_sources"),
        F.count_distinct("table_name").alias("n_tables"),
        F.max("confidence").alias("confidence"),
        F.min(order).alias("ord"),
        *(first_seen(v, order).alias(name) for name, v in given.items()),
    )


def enrich(hosts: DataFrame) -> DataFrame:
    """Environment and datacenter where missing, host type, and the quality score."""
    name = F.lower("hostname")
    hosts = hosts.withColumns(
        {
            "given_environment": F.col("environment"),
            "environment": F.coalesce("environment", H.first_keyword(name, K.ENVIRONMENTS, "unknown")),
            "datacenter": H.datacenter(F.col("hostname"), F.col("ip_address")),
            "host_type": H.first_keyword(name, K.HOST_TYPES, "compute"),
        }
    )
    held = [F.when(H.present(F.col(f)), w).otherwise(0.0) for f, w in K.DISCOVERY_WEIGHTS.items()]
    weight = sum(K.DISCOVERY_WEIGHTS.values()) + 0.2
    return hosts.withColumn("quality_score", (reduce(lambda a, b: a + b, held) + F.col("confidence") * 0.2) / weight)


def discover(raw: DataFrame) -> DataFrame:
    """Hosts of raw inventory rows."""
    return enrich(group_hosts(picked(raw)))


def attributes(rows: DataFrame) -> DataFrame:
    """Rows hostname, attribute, value, table_name, row_id: all non-null attributes of picked rows, addresses only if valid."""
    ip = F.when(H.valid_ip(F.col("ip_address")), F.col("ip_address"))
    pairs = [("ip_address", ip), ("environment", F.lower("environment")), ("application", F.lower("application")), *((a, F.col(a).cast("string")) for a in ATTRIBUTES)]
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("attribute"), v.alias("value")) for n, v in pairs))).alias("x")
    return rows.select("hostname", "table_name", "row_id", each).select("hostname", "table_name", "row_id", "x.*").filter("value is not null")


def distinct_attributes(rows: DataFrame) -> DataFrame:
    """Values of each host's attributes without repeats (case ignored), numbered by first sight."""
    seen = attributes(rows).groupBy("hostname", "attribute", F.lower("value").alias("folded")).agg(F.min(F.struct("table_name", "row_id", "value")).alias("first"))
    place = Window.partitionBy("hostname", "attribute").orderBy("first.table_name", "first.row_id", "folded")
    return seen.select("hostname", "attribute", F.row_number().over(place).alias("place"), F.col("first.value").alias("value"))


def merged_sources(rows: DataFrame) -> DataFrame:
    """Per host over all its sources: rows, tables, and how many attributes and distinct values they give together."""
    hosts = rows.groupBy("hostname").agg(F.count("*").alias("n_rows"), F.array_join(F.array_sort(F.collect_set("table_name")), ",").alias("sources"))  # a name a table
    held = attributes(rows).select("hostname", "attribute", F.lower("value").alias("value")).distinct()
    held = held.groupBy("hostname").agg(F.count_distinct("attribute").alias("n_attributes"), F.count("*").alias("n_values"))
    return hosts.join(held, "hostname", "left").na.fill(0, ["n_attributes", "n_values"])


def merged_attributes(rows: DataFrame) -> DataFrame:
    """The attribute lists of each host's sources one after the other: a row a value, with its place in the list."""
    place = F.row_number().over(Window.partitionBy("hostname", "attribute").orderBy("table_name", "row_id", "value"))
    return attributes(rows).select("hostname", "attribute", "table_name", place.alias("place"), "value")


def base_name(hostname: Column) -> Column:
    return F.when(hostname.contains("."), F.substring_index(hostname, ".", 1)).otherwise(F.regexp_replace(hostname, r"\d+", ""))


def duplicate_groups(hosts: DataFrame) -> DataFrame:
    """Rows key, best, n for each address or base name that more than one host has; best has the highest quality."""
    keys = F.array_compact(F.array(F.concat(F.lit("ip:"), "ip_address"), F.concat(F.lit("base:"), base_name(F.col("hostname")))))
    each = hosts.select("hostname", "quality_score", F.explode(keys).alias("key"))
    best = F.min(F.struct((-F.col("quality_score")).alias("q"), "hostname"))
    return each.groupBy("key").agg(F.count("*").alias("n"), best.alias("b")).filter("n > 1").select("key", F.col("b.hostname").alias("best"), "n")


def merge_duplicates(hosts: DataFrame, components: DataFrame) -> DataFrame:
    """One row for each group of hosts that share an address or base name, directly or over others: the host of the best
    quality, its group's sources and tables together, the highest confidence and the number of hosts.

    components: id, component over the links that duplicate_links gives.
    """
    rows = hosts.join(components.withColumnRenamed("id", "hostname"), "hostname")
    best = F.min(F.struct((-F.col("quality_score")).alias("q"), "hostname", "environment", "application", "ip_address"))
    merged = rows.groupBy("component").agg(best.alias("b"), F.count("*").alias("n_hosts"), F.sum("n_sources").alias("n_sources"), F.max("confidence").alias("confidence"))
    return merged.select("b.hostname", "b.environment", "b.application", "b.ip_address", "n_hosts", "n_sources", "confidence")


def duplicate_links(hosts: DataFrame) -> DataFrame:
    """Edges source, target from each host to the best one of each of its groups."""
    keys = F.array_compact(F.array(F.concat(F.lit("ip:"), "ip_address"), F.concat(F.lit("base:"), base_name(F.col("hostname")))))
    each = hosts.select("hostname", F.explode(keys).alias("key"))
    return each.join(duplicate_groups(hosts), "key").filter("hostname <> best").select(F.col("hostname").alias("source"), F.col("best").alias("target"))
