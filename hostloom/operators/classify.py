"""Enrichment and classification of hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import host as H
from . import discovery as D


def first_values(picked: DataFrame, n: int = 5) -> DataFrame:
    """The first n values of each host's attributes in row order, repeats included."""
    order = Window.partitionBy("hostname", "attribute").orderBy("table_name", "row_id")
    return D.attributes(picked).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def reduce_attributes(picked: DataFrame, types: dict[str, str]) -> DataFrame:
    """One value for each attribute of a host: the only one, the latest of dates, the median of numbers, else all of them in row order."""
    seen = D.distinct_attributes(picked).filter(F.trim("value") != "")
    kind = reduce(lambda out, x: F.when(F.col("attribute") == x[0], x[1]).otherwise(out), types.items(), F.lit("text"))
    when = F.coalesce(F.try_to_timestamp("value"), F.try_to_timestamp("value", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    grouped = seen.groupBy("hostname", "attribute").agg(
        F.count("*").alias("n"),
        F.min_by("value", "place").alias("first"),
        F.max_by("value", F.when(when.isNotNull(), F.struct(when, -F.col("place")))).alias("latest"),
        F.median(F.col("value").try_cast("double")).alias("median"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), ",").alias("all"),
    )
    many = F.when(kind.isin("timestamp", "date"), F.coalesce("latest", "first")).when(kind.isin("amount", "percentage", "numeric"), F.coalesce(F.col("median").cast("string"), "first")).otherwise(F.col("all"))
    return grouped.select("hostname", "attribute", F.when(F.col("n") == 1, F.col("first")).otherwise(many).alias("value"))


def source_scores(picked: DataFrame) -> DataFrame:
    """Confidence of a host by its occurrences, and by its sources."""
    n, tables = F.count("*"), F.count_distinct("table_name")
    least = lambda a, b: F.least(a, F.lit(b))
    return picked.groupBy("hostname").agg(
        n.alias("occurrences"),
        least(F.max("confidence") * 0.4 + F.avg("confidence") * 0.3 + least(n / 10, 1.0) * 0.2 + least(tables / 5, 1.0) * 0.1, 1.0).alias("confidence"),
        least(least(n / 5, 0.5) + F.avg("confidence") * 0.5 + least(tables / 3, 0.3), 1.0).alias("source_confidence"),
    )


def inferred(hosts: DataFrame) -> DataFrame:
    """Environment, datacenter and system by name, and the /24 network of a host that is an address."""
    name = F.lower("hostname")
    os = H.first_keyword(name, K.INFERRED_SYSTEMS)
    return hosts.select(
        "hostname",
        H.first_keyword(name, K.INFERRED_ENVIRONMENTS).alias("environment_inferred"),
        H.first_keyword(name, K.INFERRED_REGIONS).alias("datacenter_inferred"),
        F.coalesce(os, F.when(F.lower("os_type").contains("windows"), "windows").when(H.any_contains(F.lower("os_type"), ["linux", "ubuntu", "centos"]), "linux")).alias("os_inferred"),
        F.when(H.ip_shaped(F.col("hostname")), H.subnet(F.col("hostname"))).alias("network_segment"),
    )


def enriched_quality(hosts: DataFrame, scores: DataFrame) -> DataFrame:
    """Half weighted completeness, then confidence and occurrences."""
    by_name = inferred(hosts).select("hostname", "environment_inferred", "datacenter_inferred", "os_inferred")
    rows = hosts.select("hostname", "given_environment", "owner", "application", "os_type").join(by_name, "hostname").join(scores, "hostname")
    value = {"hostname": F.col("hostname"), "environment": F.coalesce("given_environment", "environment_inferred"), "datacenter": F.col("datacenter_inferred"), "os_type": F.coalesce("os_type", "os_inferred"), "owner": F.col("owner"), "application": F.col("application")}
    held = reduce(lambda a, b: a + b, (F.when(F.trim(v) != "", K.ENRICHMENT_WEIGHTS[f]).otherwise(0.0) for f, v in value.items()))
    score = held / sum(K.ENRICHMENT_WEIGHTS.values()) * 0.5 + F.col("confidence") * 0.3 + F.least(F.col("occurrences") / 10, F.lit(1.0)) * 0.2
    return rows.select("hostname", score.alias("quality_score"))


def _hits(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.when(c.contains(w), 1).otherwise(0) for w in words))


def entity_type(hosts: DataFrame, picked: DataFrame) -> DataFrame:
    """The entity type of the highest score, the first one of equals. Seven scores a host, no join with the rules."""
    values = first_values(picked).groupBy("hostname", "attribute").agg(*(F.sum(F.when(H.any_contains(F.lower("value"), words), 1).otherwise(0)).alias(f"v{k}") for k, (_, _, words, _) in enumerate(K.ENTITY_TYPES)))
    held = values.groupBy("hostname").agg(*(F.sum(F.col(f"v{k}") + _hits(F.lower("attribute"), words)).alias(f"a{k}") for k, (_, _, words, _) in enumerate(K.ENTITY_TYPES)))
    name = F.lower("hostname")
    scores = []
    for k, (_, patterns, words, boost) in enumerate(K.ENTITY_TYPES):
        pattern = F.when(name.rlike("|".join(patterns)), 0.4).otherwise(0.0)
        scores.append(F.least(F.round(pattern + _hits(name, words) * 0.2 + F.coalesce(f"a{k}", F.lit(0)) * 0.1 + boost, 9), F.lit(1.0)))
    best = F.greatest(*scores)
    kind = F.lit(K.ENTITY_TYPES[-1][0])
    for (name_, *_), score in reversed(list(zip(K.ENTITY_TYPES, scores, strict=True))):
        kind = F.when(score == best, name_).otherwise(kind)
    return hosts.select("hostname").join(held, "hostname", "left").select("hostname", kind.alias("type"), best.alias("type_confidence"))


def sub_type(hosts: DataFrame, picked: DataFrame) -> DataFrame:
    """The first sub-type with a keyword in the name, in an attribute's name or in its first values; else by the last rules."""
    place = lambda c: reduce(lambda out, x: F.when(H.any_contains(c, x[1][1]), x[0]).otherwise(out), reversed(list(enumerate(K.SUB_TYPES))), F.lit(99))
    by_value = first_values(picked).groupBy("hostname").agg(F.min(F.least(place(F.lower("value")), place(F.lower("attribute")))).alias("place"))
    name = F.lower("hostname")
    best = F.least(place(name), F.coalesce("place", F.lit(99)))
    named = reduce(lambda out, x: F.when(best == x[0], x[1][0]).otherwise(out), enumerate(K.SUB_TYPES), F.lit(None).cast("string"))
    return hosts.select("hostname").join(by_value, "hostname", "left").select("hostname", F.coalesce(named, H.first_keyword(name, K.LAST_SUB_TYPES), F.lit("general_purpose")).alias("sub_type"))


def attribute_confidence(picked: DataFrame) -> DataFrame:
    names = D.attributes(picked).select("hostname", "attribute").distinct()
    return names.groupBy("hostname").agg(F.least(F.count_if(H.any_contains(F.lower("attribute"), K.IMPORTANT_ATTRIBUTES)) / len(K.IMPORTANT_ATTRIBUTES) + F.least(F.count("*") / 20, F.lit(0.3)), F.lit(1.0)).alias("attribute_confidence"))


def classify(hosts: DataFrame, picked: DataFrame) -> DataFrame:
    """hostname, type, sub_type, confidence, method."""
    rows = entity_type(hosts, picked).join(sub_type(hosts, picked), "hostname").join(attribute_confidence(picked), "hostname", "left").join(source_scores(picked).select("hostname", "source_confidence"), "hostname")
    rows = rows.withColumn("attribute_confidence", F.coalesce("attribute_confidence", F.lit(0.3)))
    method = F.when(F.col("type_confidence") > 0.8, "pattern_matching").when(F.round("attribute_confidence", 9) > 0.7, "attribute_analysis").when(F.round("source_confidence", 9) > 0.6, "source_correlation").otherwise("heuristic")
    mean = (F.col("type_confidence") + F.col("attribute_confidence") + F.col("source_confidence")) / 3
    return rows.select("hostname", "type", "sub_type", F.least(mean, F.lit(1.0)).alias("confidence"), method.alias("method"))


def tags(hosts: DataFrame, classes: DataFrame) -> DataFrame:
    """hostname and its tags in order."""
    name = F.lower("hostname")
    prefixed = [F.when(H.present(F.col(c)), F.concat(F.lit(p), c)) for c, p in (("environment", "env:"), ("datacenter", "dc:"), ("os_type", "os:"), ("application", "app:"), ("owner", "owner:"))]
    by_name = [
        F.when(H.any_contains(name, ["test", "qa"]), "non-production").when(H.any_contains(name, ["prod", "prd"]), "production"),
        F.when(H.any_contains(name, ["backup", "bkp"]), "backup"),
        F.when(name.contains("dr"), "disaster-recovery"),
        F.when(name.contains("dev"), "development"),
        F.when(H.any_contains(name, ["temp", "tmp"]), "temporary"),
        F.when(name.rlike("^i-[a-f0-9]{8,}"), "aws").when(name.contains("azure"), "azure").when(H.any_contains(name, ["gcp", "gce"]), "gcp"),
    ]
    every = F.array_distinct(F.array_compact(F.array(F.col("type"), F.col("sub_type"), *prefixed, *by_name)))
    return hosts.join(classes.select("hostname", "type", "sub_type"), "hostname").select("hostname", every.alias("tags"))


def criticality(hosts: DataFrame, classes: DataFrame) -> DataFrame:
    points = lambda c, table: reduce(lambda out, x: F.when(F.col(c) == x[0], x[1]).otherwise(out), table.items(), F.lit(0))
    score = points("environment", K.CRITICALITY_ENVIRONMENT) + points("application", K.CRITICALITY_APPLICATION)
    score = score + F.when(F.col("confidence") > 0.9, 10).otherwise(0) + F.when(F.col("n_sources") > 5, 20).when(F.col("n_sources") > 2, 10).otherwise(0)
    rows = hosts.select("hostname", "environment", "application", "n_sources").join(classes.select("hostname", "confidence"), "hostname")
    return rows.select("hostname", score.alias("points"), F.when(score >= 70, "critical").when(score >= 50, "high").when(score >= 30, "medium").otherwise("low").alias("criticality"))
