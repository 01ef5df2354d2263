"""Data quality: dimension scores, coverage, patterns, anomalies and insights. Fields are columns of hosts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import host as H

ANOMALY = "type string, severity string, affected string, description string"


def _add(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _links(edges: DataFrame) -> Column:
    """How many links there are: an edge between classes stands for many."""
    return F.coalesce(F.sum("links"), F.lit(0)) if "links" in edges.columns else F.count("*")


def _confidence(edges: DataFrame) -> Column:
    return F.sum(F.col("confidence") * F.col("links")) / F.sum("links") if "links" in edges.columns else F.avg("confidence")


def _as_text(c: str) -> Column:
    return F.col(c).cast("string")


def timeliness(last_seen: Column, now: str) -> Column:
    """By age in whole days; 0.3 if missing, 0.5 if it can't be read or has a zone, which can't be compared with now."""
    seen = F.try_to_timestamp(last_seen, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    days = F.floor((F.lit(now).cast("timestamp").cast("long") - seen.cast("long")) / 86400)
    by_age = F.when(days < 1, 1.0).when(days < 7, 0.9).when(days < 30, 0.7).when(days < 90, 0.5).otherwise(0.2)
    return F.when(last_seen.isNull() | (last_seen == ""), 0.3).when(seen.isNull(), 0.5).otherwise(by_age)


def validity() -> Column:
    """Mean of the checks that apply to a row: name, address, cores."""
    checks = [F.when(H.valid_hostname(F.col("hostname")), 1.0).otherwise(0.0), F.when(F.col("ip_address").isNotNull(), F.when(H.four_octets(F.col("ip_address")), 1.0).otherwise(0.0)), F.when(F.col("cpu_cores").isNotNull() & (F.col("cpu_cores") != 0), F.when(F.col("cpu_cores").between(1, 256), 1.0).otherwise(0.0))]
    return _add([F.coalesce(c, F.lit(0.0)) for c in checks]) / _add([F.when(c.isNotNull(), 1).otherwise(0) for c in checks])


def naming_patterns(hosts: DataFrame) -> DataFrame:
    """The five most common abstract patterns of names."""
    return hosts.groupBy(H.abstracted(F.col("hostname")).alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(5)


def naming_consistency(hosts: DataFrame) -> DataFrame:
    """The share of the most common pattern doubled, 1 at most, as one row."""
    counts = hosts.groupBy(H.abstracted(F.col("hostname")).alias("p")).agg(F.count("*").alias("n"))
    return counts.agg(F.least(F.max("n") / F.sum("n") * 2, F.lit(1.0)).alias("naming"))


def dimensions(hosts: DataFrame, edges: DataFrame, now: str) -> DataFrame:
    """One row: the six dimension scores and their mean. Each part is one aggregation; the parts are single rows."""
    known = [*(x for x, _ in K.ENVIRONMENTS), "sandbox", "unknown"]
    rows = hosts.agg(
        F.count("*").alias("n"),
        F.avg(_add([F.when(H.present(F.col(f)), 1.0).otherwise(0.0) for f in K.REQUIRED_FIELDS]) / len(K.REQUIRED_FIELDS)).alias("completeness"),
        F.coalesce(F.avg(F.when(F.col("ip_address").isNotNull(), F.when(H.four_octets(F.col("ip_address")), 1.0).otherwise(0.0))), F.lit(0.5)).alias("ip"),
        (F.count_distinct(F.when(F.col("environment").isin(known), F.col("environment"))) / F.greatest(F.count_distinct("environment"), F.lit(1))).alias("env"),
        (F.count_distinct("hostname") / F.count("*")).alias("uniqueness"),
        F.avg(validity()).alias("validity"),
        F.avg(timeliness(F.col("last_seen"), now)).alias("timeliness"),
    )
    links = edges.agg(_links(edges).alias("m"), _confidence(edges).alias("c"))
    density = F.col("m") / (F.col("n") * (F.col("n") - 1) / 2)
    score = F.when(density < 0.05, density * 20).when(density > 0.2, 1 - (density - 0.2) * 2).otherwise(1.0)
    rows = rows.crossJoin(naming_consistency(hosts)).crossJoin(links)  # three single rows
    rows = rows.withColumns({"consistency": (F.col("naming") + F.col("ip") + F.col("env")) / 3, "relationships": (score + F.coalesce("c", F.lit(0.0))) / 2})
    six = ["completeness", "consistency", "uniqueness", "validity", "timeliness", "relationships"]
    return rows.select(*six, (_add([F.col(c) for c in six]) / 6).alias("overall"))


def coverage(hosts: DataFrame, fields: list[str]) -> DataFrame:
    """Percent of hosts that have each field."""
    shares = hosts.agg(*(F.avg(F.when(H.present(_as_text(f)), 100.0).otherwise(0.0)).alias(f) for f in fields))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("percent")) for f in fields))).alias("x")).select("x.*")


def distributions(hosts: DataFrame, fields: list[str]) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.coalesce(_as_text(f), F.lit("unknown")).alias("value")) for f in fields))).alias("x")
    return hosts.select(each).select("x.*").filter("value <> ''").groupBy("field", "value").agg(F.count("*").alias("n"))


def recommendations(scores: DataFrame, covered: DataFrame) -> DataFrame:
    """Texts for dimensions and critical fields under a half, ten at most."""
    by_score = scores.select(F.explode(F.array_compact(F.array(*(F.when(F.col(d) < 0.5, F.struct(F.lit(k).alias("place"), F.lit(t).alias("text"))) for k, (d, t) in enumerate(K.RECOMMENDATIONS.items()))))).alias("x")).select("x.*")
    critical = ["environment", "owner", "application", "datacenter"]
    by_field = covered.filter(F.col("field").isin(critical) & (F.col("percent") < 50)).select((F.lit(10) + F.array_position(F.lit(critical), F.col("field"))).cast("int").alias("place"), F.format_string("Improve %s identification - only %.1f%% coverage", "field", "percent").alias("text"))
    return by_score.unionByName(by_field).orderBy("place").limit(10)


def duplicates(hosts: DataFrame, column: str, severity: str, text: str) -> DataFrame:
    rows = hosts.filter(F.col(column) != "").groupBy(F.col(column).alias("affected")).agg(F.count("*").alias("n")).filter("n > 1").orderBy("affected").limit(10)
    name = "duplicate_hostname" if column == "hostname" else "duplicate_ip"
    return rows.select(F.lit(name).alias("type"), F.lit(severity).alias("severity"), "affected", F.format_string(text, "affected", "n").alias("description"))


def naming_violations(hosts: DataFrame, literal: bool = True) -> DataFrame:
    """Of the first hundred names, ten at most that fit none of the three most common patterns; literal takes the
    abstract patterns as they are written, so that any name with digits is named."""
    top = hosts.groupBy(H.abstracted(F.col("hostname")).alias("pattern")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pattern").limit(3)
    held = top.agg(F.collect_list("pattern").alias("patterns"))  # three patterns
    first = hosts.select("hostname").orderBy("hostname").limit(100).crossJoin(held)
    name = F.col("hostname") if literal else H.abstracted(F.col("hostname"))
    return first.filter(~F.exists("patterns", lambda p: name.startswith(p))).orderBy("hostname").limit(10).select(F.lit("naming_violation").alias("type"), F.lit("low").alias("severity"), F.col("hostname").alias("affected"), F.format_string("Hostname '%s' doesn't match common patterns", "hostname").alias("description"))


def resource_anomalies(hosts: DataFrame) -> DataFrame:
    held = hosts.filter("cpu_cores <> 0").agg(F.avg("cpu_cores").alias("mean"), F.stddev_samp("cpu_cores").alias("sd"))
    outliers = hosts.filter("cpu_cores <> 0").crossJoin(held).filter("sd > 0 and abs((cpu_cores - mean) / sd) > 3")  # one row of moments
    outliers = outliers.select(F.lit(0).alias("family"), F.col("hostname").alias("affected"), F.lit("resource_outlier").alias("type"), F.format_string("Unusual CPU allocation: %d cores (avg: %.1f)", "cpu_cores", "mean").alias("description"))
    over = hosts.filter("environment in ('development', 'testing', 'sandbox') and (cpu_cores > 16 or memory_gb > 64)")
    over = over.select(F.lit(1).alias("family"), F.col("hostname").alias("affected"), F.lit("over_provisioned").alias("type"), F.format_string("%s environment with high resources: %d CPU, %dGB RAM", F.initcap("environment"), F.coalesce("cpu_cores", F.lit(0)), F.coalesce("memory_gb", F.lit(0))).alias("description"))
    return outliers.unionByName(over).orderBy("family", "affected").limit(20).select("type", F.lit("medium").alias("severity"), "affected", "description")


def orphans(hosts: DataFrame, edges: DataFrame) -> DataFrame:
    linked = edges.select(F.col("source").alias("hostname")).union(edges.select("target"))
    return hosts.select("hostname").join(linked, "hostname", "left_anti")


def orphan_anomalies(hosts: DataFrame, edges: DataFrame) -> DataFrame:
    alone = orphans(hosts, edges)
    counts = alone.agg(F.count("*").alias("k")).crossJoin(hosts.agg(F.count("*").alias("n")))
    many = counts.filter("k > n * 0.3").select(F.lit("high_orphan_rate").alias("type"), F.lit("high").alias("severity"), F.lit("").alias("affected"), F.format_string("%d entities (%.1f%%) have no relationships", "k", F.col("k") * 100.0 / F.col("n")).alias("description"))
    few = alone.orderBy("hostname").limit(10).crossJoin(counts.filter("k <= n * 0.3"))
    return many.unionByName(few.select(F.lit("orphaned_entity").alias("type"), F.lit("low").alias("severity"), F.col("hostname").alias("affected"), F.format_string("Entity '%s' has no relationships", "hostname").alias("description")))


def drift(hosts: DataFrame) -> DataFrame:
    rows = hosts.filter(H.present(F.col("application")) & H.present(F.col("environment")))
    groups = rows.groupBy(F.concat_ws(":", "application", "environment").alias("affected")).agg(
        F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.coalesce("os_type", F.lit("unknown")))), ", ").alias("os"), F.min(F.when(F.col("cpu_cores") != 0, F.col("cpu_cores"))).alias("low"), F.max("cpu_cores").alias("high")
    ).filter("n > 1")
    by_os = groups.filter(F.col("os").contains(",")).select("affected", F.lit("configuration_drift").alias("type"), F.format_string("Inconsistent OS types in %s: %s", "affected", "os").alias("description"))
    by_cpu = groups.filter("high > low * 4").select("affected", F.lit("resource_imbalance").alias("type"), F.format_string("Large CPU variance in %s: %d-%d cores", "affected", "low", "high").alias("description"))
    return by_os.unionByName(by_cpu).orderBy("affected", "type").limit(15).select("type", F.lit("medium").alias("severity"), "affected", "description")


def missing_fields(hosts: DataFrame) -> DataFrame:
    missing = coverage(hosts, K.REQUIRED_FIELDS).select("field", (100 - F.col("percent")).alias("missing")).filter("missing > 20")
    return missing.select(F.lit("missing_field").alias("type"), F.when(F.col("missing") > 50, "high").otherwise("medium").alias("severity"), F.col("field").alias("affected"), F.format_string("Field '%s' missing in %.1f%% of entities", "field", "missing").alias("description"))


def test_in_production(hosts: DataFrame) -> DataFrame:
    rows = hosts.filter((F.lower("environment") == "production") & H.any_contains(F.lower("hostname"), K.TEST_WORDS)).orderBy("hostname").limit(10)
    return rows.select(F.lit("test_in_production").alias("type"), F.lit("high").alias("severity"), F.col("hostname").alias("affected"), F.format_string("Possible test entity in production: %s", F.lower("hostname")).alias("description"))


def out_of_limits(hosts: DataFrame, now: str) -> DataFrame:
    """Hosts beyond the declared limits: names of mixed case, addresses that aren't private, resources and ages out of
    bounds. hosts may lack a column, and a missing value breaks no limit."""
    have = hosts.columns
    rules = [("naming_convention", ~reduce(lambda a, b: a | b, (F.col("hostname").rlike(p) for p in K.NAMING_CONVENTIONS)))]
    if "ip_address" in have:
        rules.append(("ip_range", ~reduce(lambda a, b: a | b, (F.col("ip_address").rlike(p) for p, _ in K.PRIVATE_RANGES))))
    rules += [(c, ~F.col(c).between(*bounds)) for c, bounds in K.RESOURCE_LIMITS.items() if c in have]
    if "last_seen" in have:
        seen = F.try_to_timestamp("last_seen", F.lit("yyyy-MM-dd'T'HH:mm:ss"))
        rules.append(("age", ~F.floor((F.lit(now).cast("timestamp").cast("long") - seen.cast("long")) / 86400).between(*K.AGE_LIMITS)))
    broken = F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules)))
    return hosts.select("hostname", F.explode(broken).alias("rule"))


def anomalies(hosts: DataFrame, edges: DataFrame) -> DataFrame:
    """All families, the most severe first."""
    families = [duplicates(hosts, "hostname", "high", "Hostname '%s' appears %d times"), duplicates(hosts, "ip_address", "medium", "IP address '%s' assigned to %d entities"), naming_violations(hosts), resource_anomalies(hosts), orphan_anomalies(hosts, edges), drift(hosts), missing_fields(hosts), test_in_production(hosts)]
    rows = reduce(lambda a, b: a.unionByName(b), (f.withColumn("family", F.lit(k)) for k, f in enumerate(families)))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return rows.orderBy(rank, "family", "affected", "type").drop("family")


def insights(hosts: DataFrame, edges: DataFrame) -> DataFrame:
    """Texts by topic; hosts have their entity type in the column type. Every figure comes from one aggregation over hosts, one over edges, and a count by application."""
    cond = lambda c: F.count_if(c)
    cpu, memory = F.when(F.col("cpu_cores") != 0, F.col("cpu_cores")), F.when(F.col("memory_gb") != 0, F.col("memory_gb"))
    private = F.col("ip_address").startswith("10.") | F.col("ip_address").startswith("172.") | F.col("ip_address").startswith("192.168.")
    a = hosts.agg(
        F.count("*").alias("n"),
        cond(F.col("environment") == "production").alias("prod"),
        F.concat_ws(", ", *(F.when(~F.max(F.coalesce(F.col("environment") == e, F.lit(False))), e) for e in ("development", "production", "staging"))).alias("missing"),
        cond(F.coalesce("application", F.lit("unknown")) == "unknown").alias("no_app"),
        F.count_distinct("datacenter").alias("dcs"),
        F.count_distinct(F.coalesce("os_type", F.lit("unknown"))).alias("systems"),
        *(cond(F.col("type") == t).alias(t) for t in ("physical_server", "virtual_machine", "container")),
        cond(F.col("environment").isin("development", "testing") & ((F.coalesce("cpu_cores", F.lit(0)) > 8) | (F.coalesce("memory_gb", F.lit(0)) > 32))).alias("costly"),
        cond((F.col("ip_address") != "") & ~private).alias("public"),
        cond(~H.present(F.col("owner"))).alias("no_owner"),
        cond(F.coalesce("status", F.lit("")) != "active").alias("inactive"),
        F.count(cpu).alias("with_cpu"), F.sum(cpu).alias("cpu"), F.avg(cpu).alias("avg_cpu"), F.max(cpu).alias("max_cpu"), F.count(memory).alias("with_memory"), F.sum(memory).alias("memory"),
    ).crossJoin(edges.agg(_links(edges).alias("m"), cond(F.col("type") == "same_application").alias("apps")))
    ratio = (F.col("n") - F.col("prod")) / F.col("prod")
    density = F.col("m") / (F.col("n") * (F.col("n") - 1) / 2)
    say = lambda topic, when, text, *args: F.when(when, F.struct(F.lit(topic).alias("topic"), (F.format_string(text, *args) if args else F.lit(text)).alias("insight")))
    both = (F.col("prod") > 0) & (F.col("n") > F.col("prod"))
    rows = a.select(
        F.explode(
            F.array_compact(
                F.array(
                    say("environment", both & (ratio < 0.5), K.INSIGHTS["low_ratio"], ratio),
                    say("environment", both & (ratio > 3), K.INSIGHTS["high_ratio"], ratio),
                    say("environment", F.col("missing") != "", K.INSIGHTS["missing"], F.col("missing")),
                    say("application", F.col("no_app") > F.col("n") * 0.2, K.INSIGHTS["no_application"], F.col("no_app")),
                    say("infrastructure", F.col("dcs") == 1, K.INSIGHTS["one_place"]),
                    say("infrastructure", F.col("dcs") > 5, K.INSIGHTS["many_places"], F.col("dcs")),
                    say("infrastructure", F.col("systems") > 3, K.INSIGHTS["systems"], F.col("systems")),
                    say("infrastructure", F.col("physical_server") > F.col("virtual_machine") + F.col("container"), K.INSIGHTS["physical"]),
                    say("infrastructure", (F.col("container") > F.col("virtual_machine") * 2) & (F.col("physical_server") <= F.col("virtual_machine") + F.col("container")), K.INSIGHTS["containers"]),
                    say("relationship", F.col("m") == 0, K.INSIGHTS["no_links"]),
                    say("relationship", (F.col("m") > 0) & (density < 0.01), K.INSIGHTS["few_links"]),
                    say("relationship", density > 0.3, K.INSIGHTS["many_links"]),
                    say("relationship", F.col("apps") > F.col("m") * 0.5, K.INSIGHTS["clustering"]),
                    say("cost", F.col("costly") > 0, K.INSIGHTS["costly"], F.col("costly")),
                    say("cost", F.col("inactive") > F.col("n") * 0.1, K.INSIGHTS["inactive"], F.col("inactive")),
                    say("security", F.col("public") > 0, K.INSIGHTS["public"], F.col("public")),
                    say("security", F.col("no_owner") > F.col("n") * 0.2, K.INSIGHTS["no_owner"], F.col("no_owner")),
                    say("capacity", F.col("with_cpu") > 0, K.INSIGHTS["cpu"], F.col("cpu"), F.col("with_cpu"), F.col("avg_cpu")),
                    say("capacity", F.col("max_cpu") > F.col("avg_cpu") * 5, K.INSIGHTS["cpu_variance"]),
                    say("capacity", F.col("with_memory") > 0, K.INSIGHTS["memory"], F.col("memory"), F.col("with_memory")),
                )
            )
        ).alias("x")
    ).select("x.*")
    top = hosts.groupBy(F.coalesce("application", F.lit("unknown")).alias("app")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "app").limit(3).crossJoin(hosts.agg(F.count("*").alias("n")))
    share = F.col("k") * 100.0 / F.col("n")
    top = top.filter(share > 30).select(F.lit("application").alias("topic"), F.format_string(K.INSIGHTS["one_application"], "app", share).alias("insight"))
    return rows.unionByName(top)


def statistics(hosts: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals, distinct values and mean confidences. A missing value counts as one value and as known."""
    distinct = lambda c: F.count_distinct(F.coalesce(c, F.lit("\x00")))
    known = lambda c: F.count_if(F.coalesce(c, F.lit("")) != "unknown")
    h = hosts.agg(F.count("*").alias("entities"), distinct("environment").alias("environments"), distinct("datacenter").alias("datacenters"), distinct("application").alias("applications"), distinct("os_type").alias("os_types"), ((known("environment") + known("application") + known("owner")) / (3 * F.count("*"))).alias("accuracy"), F.avg("confidence").alias("confidence"))
    return h.crossJoin(edges.agg(_links(edges).alias("relationships"), _confidence(edges).alias("relationship_confidence")))
