"""Relationships between hosts. Families of bounded groups are equi-joins, with groups over the bound filtered before;
families without a bound are given by classes, whose members are all linked."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import host as H
from . import classify as C
from .lineage import cut, forget

EDGE = ["source", "target", "type", "confidence", "via_attribute"]
#: Edges that a task sorts, about.
SORTED = 1 << 18


def sized(rows: DataFrame, key: str, least: int, most: int) -> DataFrame:
    """Rows whose key has from least to most rows; counted with partial aggregation, not a window."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("size")).filter(F.col("size").between(least, most))
    return rows.join(sizes.select(key), key)


def same_place(hosts: DataFrame) -> DataFrame:
    """Per host: its class of one environment and of one datacenter, told by their smallest hosts, and the number of
    hosts that share its environment and application, else its environment, else its datacenter.

    Every pair of two hosts is counted once at each end, as the closest of the three kinds; an unknown place is no
    class, and a missing application equals another missing one. All members of a class are linked, so classes say
    which pairs there are, and no pair is formed.
    """
    rows = hosts.select("hostname", "environment", "datacenter", F.coalesce("application", F.lit("")).alias("app"))
    known = lambda c: F.col(c) != "unknown"
    count = F.count("*")
    by_env = rows.filter(known("environment")).groupBy("environment").agg(count.alias("env"), F.min("hostname").alias("environment_class"))
    by_app = rows.filter(known("environment") & known("app")).groupBy("environment", "app").agg(count.alias("apps"))
    by_dc = rows.filter(known("datacenter")).groupBy("datacenter").agg(count.alias("dc"), F.min("hostname").alias("datacenter_class"))
    by_both = rows.filter(known("environment") & known("datacenter")).groupBy("datacenter", "environment").agg(count.alias("both"))
    rows = rows.join(by_env, "environment", "left").join(by_app, ["environment", "app"], "left").join(by_dc, "datacenter", "left").join(by_both, ["datacenter", "environment"], "left")
    apps = F.coalesce(F.col("apps") - 1, F.lit(0))
    return rows.select(
        "hostname",
        "environment_class",
        "datacenter_class",
        apps.alias("same_application"),
        F.coalesce(F.col("env") - 1 - apps, F.lit(0)).alias("same_environment"),
        F.coalesce(F.col("dc") - F.coalesce("both", F.lit(1)), F.lit(0)).alias("same_datacenter"),
    )


def attribute_keys(hosts: DataFrame, picked: DataFrame) -> DataFrame:
    """Rows hostname, key: the index that shared attributes are found by."""
    short = F.array_compact(F.array(*(F.when(H.present(F.col(c)), F.concat(F.lit(p), c)) for c, p in (("environment", "env:"), ("datacenter", "dc:"), ("application", "app:"), ("owner", "owner:")))))
    named = hosts.select("hostname", F.explode(short).alias("key"))
    valued = C.first_values(picked).filter("value <> ''").select("hostname", F.concat_ws(":", "attribute", F.lower("value")).alias("key"))
    return named.unionByName(valued.join(hosts.select("hostname"), "hostname", "left_semi")).distinct()


def shared_attributes(hosts: DataFrame, picked: DataFrame) -> DataFrame:
    keys = cut(sized(cut(attribute_keys(hosts, picked)), "key", 2, 50))
    pairs = keys.alias("a").join(keys.alias("b"), "key").filter("a.hostname < b.hostname")
    via = F.substring_index("key", ":", 1)
    kinds = {"env": ("same_environment", 0.5), "dc": ("same_datacenter", 0.6), "app": ("same_application", 0.9), "owner": ("same_owner", 0.5), "cluster": ("same_cluster", 0.9), "cluster_name": ("same_cluster", 0.9), "cluster_id": ("same_cluster", 0.9)}
    kind = reduce(lambda out, x: F.when(via == x[0], x[1][0]).otherwise(out), kinds.items(), F.lit("shares_attribute"))
    conf = reduce(lambda out, x: F.when(via == x[0], x[1][1]).otherwise(out), kinds.items(), F.lit(0.4))
    return pairs.select(F.col("a.hostname").alias("source"), F.col("b.hostname").alias("target"), kind.alias("type"), conf.alias("confidence"), via.alias("via_attribute"))


def same_network(hosts: DataFrame, reach: int = 9) -> DataFrame:
    """Each host with the next ones of its /24 network, by name."""
    rows = hosts.filter(H.four_octets(F.col("ip_address"))).select("hostname", H.subnet(F.col("ip_address")).alias("subnet"))
    rows = cut(sized(rows, "subnet", 2, 100).withColumn("rn", F.row_number().over(Window.partitionBy("subnet").orderBy("hostname"))))
    pairs = rows.alias("a").join(rows.alias("b"), "subnet").filter((F.col("b.rn") > F.col("a.rn")) & (F.col("b.rn") <= F.col("a.rn") + reach))
    return pairs.select(F.col("a.hostname").alias("source"), F.col("b.hostname").alias("target"), F.lit("same_network").alias("type"), F.lit(0.7).alias("confidence"), F.concat(F.lit("subnet:"), "subnet").alias("via_attribute"))


def application_classes(hosts: DataFrame) -> DataFrame:
    """hostname, first: hosts of one environment, datacenter and application, and the smallest host of them."""
    keys = ["environment", "datacenter", "app"]
    rows = hosts.select("hostname", "environment", "datacenter", F.coalesce("application", F.lit("unknown")).alias("app"))
    return rows.join(rows.groupBy(*keys).agg(F.min("hostname").alias("first")), keys).select("hostname", "first")


def application_patterns(hosts: DataFrame) -> DataFrame:
    """Links of hosts in one environment and datacenter whose applications are known to work together; the pattern
    gives the direction. All hosts of one application there are linked with all of the other, so an edge joins the
    smallest hosts of the two classes (application_classes tells the others) and says how many links it stands for.
    """
    spark = hosts.sparkSession
    patterns = F.broadcast(spark.createDataFrame(K.APPLICATION_PATTERNS, "app string, other string, type string"))  # of a fixed size
    rows = hosts.groupBy("environment", "datacenter", F.coalesce("application", F.lit("unknown")).alias("app")).agg(F.min("hostname").alias("source"), F.count("*").alias("n"))
    other = rows.select("environment", "datacenter", F.col("app").alias("other"), F.col("source").alias("target"), F.col("n").alias("m"))
    pairs = rows.join(patterns, "app").join(other, ["environment", "datacenter", "other"])
    links = F.col("n") * (F.col("m") - F.when(F.col("app") == F.col("other"), 1).otherwise(0))
    return pairs.select("source", "target", "type", F.lit(0.8).alias("confidence"), F.format_string("app_pattern:%s->%s", "app", "other").alias("via_attribute"), links.alias("links")).filter("links > 0")


def label_classes(hosts: DataFrame) -> DataFrame:
    """hostname, base, first: the first label of a host's name, and the smallest host that has it."""
    rows = hosts.select("hostname", F.substring_index("hostname", ".", 1).alias("base"))
    return rows.join(rows.groupBy("base").agg(F.min("hostname").alias("first")), "base").select("hostname", "base", "first")


def hierarchy(hosts: DataFrame) -> DataFrame:
    """Parents by hyphenated prefixes of first labels: every proper prefix of a label is looked up, no pair is tested. All hosts of a
    label are parents of all those of a longer one, so an edge joins the smallest hosts of two labels (label_classes tells the
    others) and says how many links it stands for."""
    rows = hosts.groupBy(F.substring_index("hostname", ".", 1).alias("base")).agg(F.min("hostname").alias("first"), F.count("*").alias("n")).withColumn("seg", F.split("base", "-"))
    upto = F.when(F.size("seg") > 1, F.sequence(F.lit(1), F.size("seg") - 1)).otherwise(F.array().cast("array<int>"))
    up = rows.select(F.col("first").alias("child"), F.col("n").alias("m"), F.explode(F.transform(upto, lambda k: F.array_join(F.slice("seg", 1, k), "-"))).alias("base"))
    pairs = up.join(rows.select(F.col("first").alias("parent"), "n", "base"), "base")
    both = F.explode(F.array(F.struct(F.col("parent").alias("source"), F.col("child").alias("target"), F.lit("parent_of").alias("type")), F.struct(F.col("child").alias("source"), F.col("parent").alias("target"), F.lit("child_of").alias("type")))).alias("x")
    return pairs.select(both, (F.col("n") * F.col("m")).alias("links")).select("x.*", F.lit(0.7).alias("confidence"), F.lit("hostname_hierarchy").alias("via_attribute"), "links")


def hierarchy_pairs(hosts: DataFrame) -> DataFrame:
    """The links that hierarchy counts, one by one: each host of a label with each of a longer one."""
    rows = hosts.select("hostname", F.substring_index("hostname", ".", 1).alias("base")).withColumn("seg", F.split("base", "-"))
    upto = F.when(F.size("seg") > 1, F.sequence(F.lit(1), F.size("seg") - 1)).otherwise(F.array().cast("array<int>"))
    up = rows.select(F.col("hostname").alias("child"), F.explode(F.transform(upto, lambda k: F.array_join(F.slice("seg", 1, k), "-"))).alias("base"))
    pairs = up.join(rows.select(F.col("hostname").alias("parent"), "base"), "base")
    both = F.explode(F.array(F.struct(F.col("parent").alias("source"), F.col("child").alias("target"), F.lit("parent_of").alias("type")), F.struct(F.col("child").alias("source"), F.col("parent").alias("target"), F.lit("child_of").alias("type")))).alias("x")
    return pairs.select(both).select("x.*", F.lit(0.7).alias("confidence"), F.lit("hostname_hierarchy").alias("via_attribute"))


def clusters(hosts: DataFrame) -> DataFrame:
    """Pairs of hosts that differ by digits only, if more than half of the gaps between their last numbers are from 1 to 10."""
    number = F.element_at(F.regexp_extract_all("hostname", F.lit(r"(\d+)")), -1).cast("decimal(38,0)")
    rows = hosts.select("hostname", F.regexp_replace("hostname", r"\d+", "").alias("base"), F.when(F.col("hostname").rlike(r"\d"), number).alias("number"))
    rows = cut(sized(rows, "base", 2, 20))
    gap = F.col("number") - F.lag("number").over(Window.partitionBy("base").orderBy("number"))
    good = rows.filter("number is not null").select("base", gap.alias("gap")).filter("gap is not null").groupBy("base").agg(F.avg(F.when(F.col("gap").between(1, 10), 1.0).otherwise(0.0)).alias("share")).filter("share > 0.5")
    rows = cut(rows.join(good.select("base"), "base"))  # read twice: a task that made both sides would hold all of their sorts at once
    pairs = rows.alias("a").join(rows.alias("b"), "base").filter("a.hostname < b.hostname")
    return pairs.select(F.col("a.hostname").alias("source"), F.col("b.hostname").alias("target"), F.lit("same_cluster").alias("type"), F.lit(0.8).alias("confidence"), F.concat(F.lit("cluster:"), "base").alias("via_attribute"))


def _both_ways(kind: Column) -> Column:
    return kind.isin([k for k, (_, both, _) in K.RELATIONSHIP_TYPES.items() if both])


def deduplicate(edges: DataFrame, directed: bool = False, parts: int | None = None) -> DataFrame:
    """One edge for each pair and type, the most confident; of equals the first by via_attribute and direction. parts: tasks that edges are dealt over before
    they are sorted (null: they are sorted where they are, and once more where pairs meet)."""
    both = F.lit(False) if directed else _both_ways(F.col("type"))
    a = F.when(both, F.least("source", "target")).otherwise(F.col("source"))
    b = F.when(both, F.greatest("source", "target")).otherwise(F.col("target"))
    more = [c for c in edges.columns if c not in EDGE]
    best = F.min(F.struct((-F.col("confidence")).alias("c"), "via_attribute", "source", "target", "confidence", *more)).alias("x")
    keyed = edges.select("*", a.alias("ka"), b.alias("kb"))
    keyed = keyed.repartition(parts, "ka", "kb", "type") if parts else keyed
    return keyed.groupBy("ka", "kb", "type").agg(best).select("x.source", "x.target", "type", "x.confidence", "x.via_attribute", *(f"x.{c}" for c in more))


def families(hosts: DataFrame, picked: DataFrame) -> DataFrame:
    """The edges of all five families and how many links each stands for: one, but for those between classes of applications."""
    single = [shared_attributes(hosts, picked), same_network(hosts), hierarchy_pairs(hosts), clusters(hosts)]
    frames = [application_patterns(hosts), *(f.select(*EDGE, F.lit(1).cast("long").alias("links")) for f in single)]
    return reduce(lambda a, b: a.unionByName(b), frames)


def member_edges(hosts: DataFrame, edges: DataFrame) -> DataFrame:
    """source, target: each other host of a class that application_patterns or hierarchy links, with the class's smallest host."""
    out = []
    for via, classes in (("app_pattern:", application_classes(hosts)), ("hostname_hierarchy", label_classes(hosts))):
        ends = edges.filter(F.col("via_attribute").startswith(via)).select(F.explode(F.array("source", "target")).alias("first")).distinct()
        out.append(classes.filter("hostname <> first").join(ends, "first", "left_semi").select(F.col("hostname").alias("source"), F.col("first").alias("target")))
    return out[0].unionByName(out[1]).distinct()


def all_relationships(hosts: DataFrame, picked: DataFrame) -> DataFrame:
    return deduplicate(families(hosts, picked))


def named_edges(hosts: DataFrame) -> DataFrame:
    """Edges from names and networks, which graph queries work on. The hosts are found once, and so are the edges."""
    hosts = cut(hosts.select("hostname", "ip_address"))
    found = [cut(f(hosts)) for f in (same_network, hierarchy_pairs, clusters)]
    rows = reduce(DataFrame.unionByName, found)
    out = cut(deduplicate(rows, parts=-(-rows.count() // SORTED) or 1))
    forget(*found)
    return out


def type_info(edges: DataFrame) -> DataFrame:
    """Edges with what is known of their types; the catalogue has a fixed size."""
    catalogue = edges.sparkSession.createDataFrame([(k, *v) for k, v in K.RELATIONSHIP_TYPES.items()], "type string, description string, bidirectional boolean, strength double")
    known = edges.join(F.broadcast(catalogue), "type", "left")
    return known.withColumns({"description": F.coalesce("description", F.lit("Unknown relationship type")), "bidirectional": F.coalesce("bidirectional", F.lit(True)), "strength": F.coalesce("strength", F.lit(0.5))})
