"""Queries: entity resolution, stores and messages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import host as H
from ..operators import discovery as D
from ..operators import index as I
from ..operators import resolve as R
from ..operators import tensors as T
from ..operators.lineage import cut, folder
from ..sources import buckets as K
from ..sources import sinks as S
from ..sources import warehouse as W
from ..sources.inventory import table
from ..streaming import messagelog as L
from . import views as V
from .registry import query
from .relate_queries import EDGES_SQL, edges

_KEYS = """keys AS (SELECT DISTINCT hostname, key FROM (SELECT hostname, 'p:' || left(hostname, 3) AS key FROM hosts
  UNION ALL SELECT hostname, 't:' || left(p, 3) FROM (SELECT hostname, unnest(regexp_split_to_array(hostname, '[.\\-_]')) AS p FROM hosts) WHERE length(p) >= 3
  UNION ALL SELECT hostname, 'ip:' || regexp_extract(hostname, '^(\\d+\\.\\d+)', 1) FROM hosts WHERE regexp_matches(hostname, '^\\d+\\.\\d+')
  UNION ALL SELECT hostname, 'd:' || string_split(hostname, '.')[-2] FROM hosts WHERE contains(hostname, '.')))"""
_PAIRS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY hostname) AS rn, count(*) OVER (PARTITION BY key) AS n FROM keys),
pairs AS (SELECT DISTINCT x.hostname AS a, y.hostname AS b FROM ranked x JOIN ranked y USING (key) WHERE x.n BETWEEN 2 AND 99 AND y.rn BETWEEN x.rn + 1 AND x.rn + 9)"""


def pairs(spark, sf):
    return R.candidate_pairs(R.blocking_keys(V.hosts(spark, sf)))


def matched(spark, sf):
    hosts, picked = cut(V.hosts(spark, sf)), V.picked(spark, sf)
    return R.match(R.similarity(R.candidate_pairs(R.blocking_keys(hosts)), hosts, picked))


@query("e1_blocking_keys", V.with_(V.HOSTS_SQL, _KEYS) + "SELECT * FROM keys")
def blocking_keys(spark, sf):
    return R.blocking_keys(V.hosts(spark, sf))


@query("e2_candidate_pairs", V.with_(V.HOSTS_SQL, _KEYS, _PAIRS) + "SELECT * FROM pairs")
def candidate_pairs(spark, sf):
    return pairs(spark, sf)


@query("e3_nearest", "SELECT query, neighbour, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) AS rank FROM (SELECT q.vec_id AS query, e.vec_id AS neighbour, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS distance FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 10")
def nearest(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return R.nearest(rows, rows.filter("id % 20 = 0")).withColumn("distance", F.round("distance", 6))


@query("e4_e5_similarity")
def similarity(spark, sf):
    return R.similarity(pairs(spark, sf), V.hosts(spark, sf), V.picked(spark, sf)).withColumn("similarity", F.round("similarity", 9))


@query("e6_matches")
def matches(spark, sf):
    return matched(spark, sf).withColumn("similarity", F.round("similarity", 9))


def _score(c):
    return f"(contains({c}, '.')::INT * 2 + (NOT regexp_matches({c}, '\\d'))::INT + length({c}))"


@query("e7_masters", V.with_(V.HOSTS_SQL, _KEYS, _PAIRS) + f"SELECT a, b, CASE WHEN {_score('b')} > {_score('a')} THEN b ELSE a END AS master FROM pairs")
def masters(spark, sf):
    return R.masters(pairs(spark, sf))


@query("e8_merged_attributes")
def merged_attributes(spark, sf):
    return R.merge_attributes(R.masters(matched(spark, sf)), V.picked(spark, sf))


_TEXT = "SELECT hostname, hostname || ' ' || array_to_string(list_sort(list_distinct(list_filter([split_part(hostname, '.', 1), ip_address], lambda x: x IS NOT NULL))), ' ') AS text FROM hosts"
_VECTORS = f"texts AS ({_TEXT}), vectors AS MATERIALIZED (SELECT hostname, {H.sql_hashed_embedding('text', 384)} AS vector FROM texts)"
#: All pairs: an index that probes all of its lists gives the same.
_NEAREST = f"{_VECTORS}, near AS (SELECT * FROM (SELECT a.hostname AS query, b.hostname AS neighbour, list_distance(a.vector::DOUBLE[], b.vector::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY a.hostname ORDER BY list_distance(a.vector::DOUBLE[], b.vector::DOUBLE[]), b.hostname) AS rank FROM vectors a JOIN vectors b ON a.hostname <> b.hostname) WHERE rank <= 10)"


@query("e9_blocking_text", V.with_(V.HOSTS_SQL) + _TEXT)
def blocking_text(spark, sf):
    return texts(spark, sf)


def texts(spark, sf):
    forms = F.array_sort(F.array_distinct(F.array_compact(F.array(F.substring_index("hostname", ".", 1), F.col("ip_address")))))
    return V.hosts(spark, sf).select("hostname", F.concat_ws(" ", "hostname", F.array_join(forms, " ")).alias("text"))


@query("e9_blocking_vectors", V.with_(V.HOSTS_SQL, _VECTORS) + "SELECT hostname, vector FROM vectors")
def blocking_vectors(spark, sf):
    return R.blocking_vectors(texts(spark, sf))


def near_hosts(spark, sf):
    """The nearest hosts of every host, by an index of the vectors of their names and forms."""
    rows = cut(R.blocking_vectors(texts(spark, sf)).select(F.col("hostname").alias("id"), F.col("vector").cast("array<double>").alias("vector")))
    return I.search(I.build(rows), rows, k=10, probes=8)


@query("e3_e9_indexed_neighbours", V.with_(V.HOSTS_SQL, _NEAREST) + "SELECT query, neighbour, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM near")
def indexed_neighbours(spark, sf):
    return near_hosts(spark, sf).withColumn("distance", F.round("distance", 6))


@query("e3_e9_united_candidates", V.with_(V.HOSTS_SQL, _KEYS, _PAIRS, _NEAREST) + "SELECT a, b FROM pairs UNION SELECT least(query, neighbour), greatest(query, neighbour) FROM near")
def united_candidates(spark, sf):
    return I.candidates(near_hosts(spark, sf), pairs(spark, sf))


# Stores


@query("k2_upsert_hosts", V.with_(V.HOSTS_SQL) + "SELECT hostname, coalesce(owner, 'none') AS owner, CASE WHEN environment = 'production' THEN 2 ELSE 1 END AS version FROM hosts")
def upsert_hosts(spark, sf):
    owner = F.coalesce("owner", F.lit("none")).alias("owner")
    old = V.hosts(spark, sf).select("hostname", F.when(F.col("environment") == "production", "stale").otherwise(owner).alias("owner"), F.lit(1).alias("version"))
    new = V.hosts(spark, sf).filter("environment = 'production'").select("hostname", owner, F.lit(2).alias("version"))
    return S.upsert(old, new, ["hostname"])


@query("k2_attribute_rows", V.with_(V.PICKED_SQL, V.ATTRIBUTES_SQL) + "SELECT hostname, attribute, CAST(least(count(DISTINCT value), 10) AS INT) AS n FROM attributes GROUP BY 1, 2")
def attribute_rows(spark, sf):
    rows = S.attribute_rows(D.attributes(V.picked(spark, sf)))
    n = F.when(F.col("value").startswith("["), F.size(F.from_json("value", "array<string>"))).otherwise(1)
    return rows.select("hostname", "attribute", n.alias("n"))


@query("k3_upsert_edges", V.with_(EDGES_SQL) + "SELECT source, target, type, 2 AS version FROM edges")
def upsert_edges(spark, sf):
    e = edges(spark, sf).select("source", "target", "type")
    return S.upsert(e.withColumn("version", F.lit(1)), e.withColumn("version", F.lit(2)), ["source", "target", "type"])


@query("k5_statistics", V.with_(V.HOSTS_SQL) + "SELECT 'entities' AS key, CAST(count(*) AS VARCHAR) AS value FROM hosts UNION ALL SELECT 'environments', CAST(count(DISTINCT environment) AS VARCHAR) FROM hosts")
def statistics(spark, sf):
    return S.statistics_rows(V.hosts(spark, sf).agg(F.count("*").alias("entities"), F.count_distinct("environment").alias("environments")))


def stored(spark, sf):
    """Hosts and the ends of their edges as two stored tables in buckets by host name."""
    hosts = V.hosts(spark, sf).select("hostname", "environment", F.lit(1).alias("version"))
    ends = edges(spark, sf).select(F.col("source").alias("hostname"), "target", "type")
    root, tag = folder(spark), uuid.uuid4().hex
    return K.buckets(spark, f"hosts_{tag}", f"{root}/hosts", ["hostname"], 8).write(hosts), K.buckets(spark, f"ends_{tag}", f"{root}/ends", ["hostname"], 8).write(ends)


@query("k4_bucketed_join", V.with_(EDGES_SQL) + "SELECT environment, type, count(*) AS n FROM edges JOIN hosts ON source = hostname GROUP BY 1, 2")
def bucketed_join(spark, sf):
    hosts, ends = stored(spark, sf)
    return hosts.read().join(ends.read().hint("merge"), "hostname").groupBy("environment", "type").agg(F.count("*").alias("n"))


@query("k4_bucketed_upsert", V.with_(V.HOSTS_SQL) + "SELECT hostname, CASE WHEN starts_with(hostname, 'web-prod') THEN 'changed' ELSE environment END AS environment, CASE WHEN starts_with(hostname, 'web-prod') THEN 2 ELSE 1 END AS version FROM hosts UNION ALL SELECT 'web-prod-new.example.com', 'changed', 2")
def bucketed_upsert(spark, sf):
    hosts, _ = stored(spark, sf)
    changed = cut(hosts.read().filter("hostname like 'web-prod%'").select("hostname", F.lit("changed").alias("environment"), F.lit(2).alias("version")))
    hosts.upsert(changed.unionByName(spark.createDataFrame([("web-prod-new.example.com", "changed", 2)], changed.schema)))
    return hosts.read()


@query("s22_warehouse_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def warehouse_scan(spark, sf):
    rows = W.read(spark, "orders", ["o_orderkey", "o_totalprice", "o_orderstatus"], folder=sf)
    return rows.filter("o_totalprice > 200000 and o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")


@query("s19_k11_message_log", V.with_(V.HOSTS_SQL) + "SELECT 'discoveries' AS topic, hostname AS key, environment FROM hosts")
def message_log(spark, sf):
    path = folder(spark)
    L.publish(S.messages(V.hosts(spark, sf).select("hostname", "environment"), "discoveries", "2024-01-31T00:00:00"), path)
    held = spark.read.format("messagelog").options(path=path, topics="discoveries").load()
    return held.select("topic", "key", F.get_json_object("value", "$.environment").alias("environment"))


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '\\w+')"


@query("s23_text_tensors", f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
known AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY n DESC, word) + 1 AS word_id FROM (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY 1 ORDER BY n DESC, word LIMIT 500)),
each AS (SELECT doc_id, k, coalesce(word_id, 1) AS v FROM (SELECT doc_id, unnest(w[1:16]) AS word, unnest(range(1, least(len(w), 16) + 1)) AS k FROM d) LEFT JOIN known USING (word)),
found AS (SELECT doc_id, list(v ORDER BY k) AS v FROM each GROUP BY 1)
SELECT doc_id, CAST(len(w) AS INT) AS n, list_concat(coalesce(v, []), list_transform(range(16), lambda x: 0))[1:16]::INT[] AS ids, list_concat(list_transform(coalesce(v, []), lambda x: 1), list_transform(range(16), lambda x: 0))[1:16]::INT[] AS mask FROM d LEFT JOIN found USING (doc_id)""")
def text_tensors(spark, sf):
    docs = table(spark, sf, "documents")
    return T.encoded(docs, cut(T.vocabulary(docs, 500)), 16, id_col="doc_id").withColumnRenamed("id", "doc_id")


@query("k11_k12_messages", V.with_(V.HOSTS_SQL) + "SELECT 'discoveries' AS topic, hostname AS key, environment FROM hosts")
def messages(spark, sf):
    sent = S.messages(V.hosts(spark, sf).select("hostname", "environment", "datacenter"), "discoveries", "2024-01-31T00:00:00")
    return sent.select("topic", "key", F.get_json_object("value", "$.environment").alias("environment"))


@query("x1_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, sf):
    from ..streaming.discover import windowed

    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(rows).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 6).alias("value"))
