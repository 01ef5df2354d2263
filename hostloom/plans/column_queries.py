"""Queries: column profiles and semantic types; scans of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import host as H
from ..operators import discovery as D
from ..operators import profile as P
from ..operators import sample as B
from ..operators import scan as S
from ..sources.inventory import table
from . import views as V
from .discovery_queries import _CATALOG, catalog
from .registry import query

SAMPLED = {
    "customer": ("c_custkey", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]),
    "part": ("p_partkey", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]),
    "orders": ("o_orderkey", ["o_orderkey", "o_orderstatus", "o_orderpriority"]),
    "events": ("event_id", ["event_id", "user_id", "event_type", "props"]),
    "host_raw": ("row_id", ["host_name", "ip_address", "environment", "application", "owner", "os_type", "cpu_cores", "memory_gb", "last_seen"]),
}


def values(spark, sf):
    """The sampled values of all columns, from one scan a table."""
    out = None
    for t, (order, columns) in SAMPLED.items():
        df = V.raw(spark, sf).filter("table_name = 'tpch.customer'") if t == "host_raw" else table(spark, sf, t)
        rows = P.long_rows(df, t, F.col(order), columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def _long(t, order, columns):
    source = "(SELECT * FROM host_raw WHERE table_name = 'tpch.customer')" if t == "host_raw" else t
    first = f"(SELECT * FROM {source} ORDER BY {order} LIMIT 100)"
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {order} AS place, CAST({c} AS VARCHAR) AS value FROM {first}" for c in columns)


_NULLS = V.RAW_SQL + ", vals AS (" + " UNION ALL ".join(_long(t, o, c) for t, (o, c) in SAMPLED.items()) + ")"
_VALUES = _NULLS + ", v AS (SELECT table_name, column_name, place, coalesce(value, '') AS value FROM vals)"
_K = "table_name, column_name"


def rounded(df, *keep):
    return df.select(*keep, *(F.round(c, 9).alias(c) for c in df.columns if c not in keep))


def _r(x, name):
    return f"round({x}, 9) AS {name}"


@query("c1_statistics", f"WITH {_NULLS} SELECT {_K}, count(DISTINCT CASE WHEN coalesce(value, '') NOT IN ('', '0', '0.0', 'false') THEN value END) AS unique_count, count(*) FILTER (coalesce(value, '') = '') AS null_count, count(*) AS total_count, array_to_string(list_sort(list(DISTINCT value) FILTER (coalesce(value, '') NOT IN ('', '0', '0.0', 'false')))[1:10], '|') AS sample_values FROM vals GROUP BY 1, 2")
def statistics(spark, sf):
    return P.statistics(values(spark, sf)).withColumn("sample_values", F.array_join("sample_values", "|"))


_N, _X = "length(value)", "try_cast(value AS DOUBLE)"
_LEN = ", ".join(
    [_r(f"avg({_N})", "mean"), _r(f"median({_N})", "median"), _r(f"stddev_pop({_N})", "std"), _r(f"var_pop({_N})", "var"), f"min({_N}) AS min", f"max({_N}) AS max", f"max({_N}) - min({_N}) AS range"]
    + [_r(f"quantile_cont({_N}, {q})", f"p{round(q * 100)}") for q in (0.1, 0.25, 0.75, 0.9)]
    + [f"count(DISTINCT {_N}) AS n_lengths", f"count(*) FILTER ({_N} = 0) AS n_empty", _r("count(DISTINCT value) / count(*)", "unique_ratio"), _r("count(*) FILTER (value = '') / count(*)", "null_ratio")]
    + [_r(f"avg({_X})", "num_mean"), _r(f"stddev_pop({_X})", "num_std"), _r(f"min({_X})", "num_min"), _r(f"max({_X})", "num_max"), _r(f"count({_X}) / count(*)", "num_ratio")]
)


@query("c2_c3_lengths", f"WITH {_VALUES} SELECT * FROM (SELECT {_K}, {_LEN} FROM v GROUP BY 1, 2) JOIN (SELECT {_K}, max(k) AS mode_count FROM (SELECT {_K}, count(*) AS k FROM v GROUP BY {_K}, {_N}) GROUP BY 1, 2) USING (table_name, column_name)")
def lengths(spark, sf):
    return rounded(P.lengths(values(spark, sf)), *P.KEYS, "min", "max", "range", "n_lengths", "n_empty", "mode_count")


_NAMES = list(K.VALUE_PATTERNS)
for _key, _names in (("c4_patterns", _NAMES[:18]), ("c5_patterns", _NAMES)):
    query(_key, f"WITH {_VALUES} SELECT {_K}, " + ", ".join(_r(f"avg(regexp_matches(value, '{K.VALUE_PATTERNS[n]}')::INT)", n) for n in _names) + " FROM v GROUP BY 1, 2")(lambda spark, sf, names=_names: rounded(P.pattern_shares(values(spark, sf), names), *P.KEYS))


def _class(c):
    return f"sum({_N} - length(regexp_replace(value, '[{c}]', '', 'g'))) / nullif(sum({_N}), 0)"


@query("c6_characters", f"WITH {_VALUES} SELECT {_K}, " + ", ".join(_r(_class(c), n) for n, c in P.CHARACTER_CLASSES.items()) + " FROM v GROUP BY 1, 2")
def characters(spark, sf):
    return rounded(P.character_shares(values(spark, sf)), *P.KEYS)


def _quote(c):
    return c.replace("'", "''")


@query("c7_special_characters", f"WITH {_VALUES} SELECT {_K}, " + ", ".join(_r(f"sum({_N} - length(replace(value, '{_quote(c)}', ''))) / nullif(sum({_N}), 0)", f"c{ord(c)}") for c in P.SPECIAL) + ", " + _r("sum(length(regexp_replace(value, '[^\\p{L}\\p{Nd}]', '', 'g'))) / nullif(sum(length(value)), 0)", "alnum") + " FROM v GROUP BY 1, 2")
def special(spark, sf):
    return rounded(P.special_frequencies(values(spark, sf)), *P.KEYS)


def _entropy(counted):
    return f"SELECT {_K}, round(sum(k / t * log2(t / k)), 9) AS entropy FROM (SELECT *, sum(k) OVER (PARTITION BY {_K}) AS t FROM ({counted})) GROUP BY 1, 2"


@query("c8_character_entropy", f"WITH {_VALUES} " + _entropy(f"SELECT {_K}, c, count(*) AS k FROM (SELECT {_K}, unnest(string_split(value, '')) AS c FROM v WHERE value <> '') GROUP BY 1, 2, 3"))
def character_entropy(spark, sf):
    return rounded(P.gram_entropy(values(spark, sf), 1), *P.KEYS)


def _grams(n, sep):
    return f"SELECT {_K}, substring(t, i::BIGINT, {n}) AS gram FROM (SELECT {_K}, t, unnest(range(1, length(t) - {n} + 2)) AS i FROM (SELECT {_K}, string_agg(value, '{sep}' ORDER BY place, value) AS t FROM v GROUP BY 1, 2))"


@query("c8_bigram_entropy", f"WITH {_VALUES} " + _entropy(f"SELECT {_K}, gram, count(*) AS k FROM ({_grams(2, '')}) GROUP BY 1, 2, 3"))
def bigram_entropy(spark, sf):
    return rounded(P.gram_entropy(values(spark, sf), 2), *P.KEYS)


@query("c9_c10_frequencies", f"""WITH {_VALUES}, counted AS (SELECT {_K}, value, count(*) AS k FROM v GROUP BY 1, 2, 3), ranked AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY k, value) AS up, row_number() OVER (PARTITION BY {_K} ORDER BY k DESC, value DESC) AS down, sum(k) OVER (PARTITION BY {_K}) AS t FROM counted)
SELECT {_K}, max(k) AS max, min(k) AS min, {_r('avg(k)', 'mean')}, {_r('stddev_pop(k)', 'std')}, {_r('sum(CASE WHEN down <= 10 THEN k ELSE 0 END) / sum(k)', 'top10')}, {_r('2 * sum(up * k) / (count(*) * sum(k)) - (count(*) + 1) / count(*)', 'gini')}, {_r('sum(k / t * log2(t / k))', 'entropy')}, {_r('count(*) / sum(k)', 'uniqueness')} FROM ranked GROUP BY 1, 2""")
def frequencies(spark, sf):
    return rounded(P.value_frequencies(values(spark, sf)), *P.KEYS, "max", "min")


@query("c9_length_entropy", f"WITH {_VALUES} " + _entropy(f"SELECT {_K}, {_N} AS len, count(*) AS k FROM v GROUP BY 1, 2, 3"))
def length_entropy(spark, sf):
    return rounded(P.length_entropy(values(spark, sf)), *P.KEYS)


for _n in (2, 3):
    query(f"c11_top_{_n}_grams", f"WITH {_VALUES} SELECT {_K}, rank, round(share, 9) AS share FROM (SELECT {_K}, CAST(row_number() OVER (PARTITION BY {_K} ORDER BY k DESC, gram) AS INT) AS rank, k / sum(k) OVER (PARTITION BY {_K}) AS share FROM (SELECT {_K}, gram, count(*) AS k FROM ({_grams(_n, ' ')}) GROUP BY 1, 2, 3)) WHERE rank <= 10")(
        lambda spark, sf, n=_n: rounded(P.top_grams(values(spark, sf), n), *P.KEYS, "rank")
    )

_C, _L = "column_name", "lower(column_name)"
_SHAPE = f"length({_C}) AS len, length({_C}) - length(replace({_C}, '_', '')) AS underscores, length({_C}) - length(replace({_C}, '-', '')) AS hyphens, length({_C}) - length(replace({_C}, '.', '')) AS dots, (upper({_C}) = {_C} AND regexp_matches({_C}, '[A-Za-z]'))::INT AS is_upper, ({_L} = {_C} AND regexp_matches({_C}, '[A-Za-z]'))::INT AS is_lower, regexp_matches({_C}, '^[A-Z]')::INT AS first_upper, regexp_matches({_C}, '\\d')::INT AS has_digit, contains({_C}, '_')::INT AS snake, regexp_matches({_C}, '^[a-z].*[A-Z]')::INT AS camel, regexp_matches({_C}, '^[A-Z].*[A-Z]')::INT AS pascal"
for _key, _words in (("c12_name_features", K.NAME_WORDS), ("c13_name_features", K.MORE_NAME_WORDS)):
    query(_key, f"WITH {_CATALOG} SELECT table_name, column_name, concat_ws('', {', '.join(f'''contains({_L}, '{w}')::INT''' for w in _words)}) AS words, {_SHAPE} FROM catalog")(
        lambda spark, sf, words=_words: P.name_features(catalog(spark, sf), words).withColumn("words", F.array_join(F.col("words").cast("array<string>"), ""))
    )


@query("c14_feature_vector", f"WITH {_VALUES} SELECT {_K}, 1588 AS size, {_r('avg(length(value)) + ' + ' + '.join(f'avg(regexp_matches(value, {chr(39)}{K.VALUE_PATTERNS[n]}{chr(39)})::INT)' for n in _NAMES), 'total')} FROM v GROUP BY 1, 2")
def feature_vector(spark, sf):
    rows = P.lengths(values(spark, sf)).select(*P.KEYS, "mean").join(P.pattern_shares(values(spark, sf), _NAMES), P.KEYS)
    vector = P.feature_vector([F.array("mean"), F.array(*_NAMES)])
    return rows.select(*P.KEYS, F.size(vector).alias("size"), F.round(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x), 9).alias("total"))


_WORDS = "words AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z_]+')) AS word FROM documents)"


def documents(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


@query("c15_tf_idf", f"""WITH {_WORDS}, counts AS (SELECT id, word, count(*) AS k FROM words GROUP BY 1, 2), sizes AS (SELECT id, sum(k) AS len FROM counts GROUP BY 1), df AS (SELECT word, count(*) AS df FROM counts GROUP BY 1 ORDER BY df DESC, word LIMIT 500)
SELECT id, word, round(k / len * ln((SELECT count(*) FROM documents) / (df + 1)), 9) AS score FROM counts JOIN df USING (word) JOIN sizes USING (id)""")
def tf_idf(spark, sf):
    return P.tf_idf(documents(spark, sf)).withColumn("score", F.round("score", 9))


@query("c16_top_words", f"WITH {_WORDS} SELECT word, count(*) AS n FROM words GROUP BY 1 ORDER BY n DESC, word LIMIT 1000")
def top_words(spark, sf):
    return P.top_words(documents(spark, sf), 1000)


@query("c17_topics")
def topics(spark, sf):
    return P.topics(P.serialised(values(spark, sf)).select(F.col("table_name").alias("id"), "text"))


@query("c18_c20_hashed_embedding", f"WITH {_CATALOG} SELECT table_name, column_name, {H.sql_hashed_embedding("(table_name || '.' || column_name)", 64)} AS embedding FROM catalog")
def hashed_embedding(spark, sf):
    return catalog(spark, sf).select("table_name", "column_name", P.hashed_embedding(F.concat_ws(".", "table_name", "column_name")).alias("embedding"))


@query("c21_serialised", f"""WITH {_VALUES}, kept AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY place) AS rn FROM v), lines AS (SELECT {_K}, '[COL] ' || column_name || ' [VAL] ' || string_agg(value, ' | ' ORDER BY rn) AS line FROM kept WHERE rn <= 8 GROUP BY 1, 2)
SELECT table_name, left(string_agg(line, ' ' ORDER BY column_name), 2048) AS text FROM lines GROUP BY 1""")
def serialised(spark, sf):
    return P.serialised(values(spark, sf))


@query("c22_token_counts", "SELECT doc_id, CAST(least(len(regexp_extract_all(lower(text), '[0-9A-Za-z_]+|[^0-9A-Za-z_\\s]')) + 2, 512) AS INT) AS n_tokens FROM documents")
def token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", P.token_count(F.col("text")).alias("n_tokens"))


#: Pairs of columns whose relation is asked for.
RELATED = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_custkey", "orders", "o_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "supplier", "s_nationkey"), ("events", "user_id", "part", "p_size"), ("region", "r_name", "nation", "n_name")]


def _relation(a, c, b, d):
    return f"""SELECT '{a}.{c}' AS one, '{b}.{d}' AS other, n, m, shared, CASE WHEN shared >= n * 0.95 AND shared >= m * 0.95 THEN 'same_entity' WHEN shared >= n * 0.95 THEN 'foreign_key' WHEN shared >= m * 0.95 THEN 'hierarchical' ELSE 'none' END AS relation FROM
  (SELECT count(x) AS n, count(y) AS m, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS shared FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS x FROM {a}) FULL JOIN (SELECT DISTINCT CAST({d} AS VARCHAR) AS y FROM {b}) ON x = y)"""


@query("c23_relations", " UNION ALL ".join(_relation(*r) for r in RELATED))
def relations(spark, sf):
    out = None
    for a, c, b, d in RELATED:
        row = P.relation(table(spark, sf, a).select(c), table(spark, sf, b).select(d)).select(F.lit(f"{a}.{c}").alias("one"), F.lit(f"{b}.{d}").alias("other"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_KINDS = list(K.TYPE_PATTERNS)


def _scores():
    """The score of each type for each column of vals."""
    shares = ", ".join("greatest(" + ", ".join(f"avg(regexp_matches(trim(value), '(?i){p}')::INT) * {w}::DOUBLE" for p, w in ps) + f", 0) AS {t}" for t, ps in K.TYPE_PATTERNS.items())
    floor, before = {}, []
    for words, kind, value in K.NAME_HINTS:
        fits = "(" + " OR ".join(f"contains({_L}, '{w}')" for w in words) + ")"
        floor[kind] = f"CASE WHEN {fits}{''.join(f' AND NOT {b}' for b in before)} THEN {value}::DOUBLE ELSE 0 END"
        before.append(fits)
    final = ", ".join(f"round(greatest({t}, {floor.get(t, '0')}), 9) AS {t}" for t in _KINDS)
    return f"(SELECT {_K}, {final} FROM (SELECT {_K}, {shares} FROM vals WHERE value IS NOT NULL GROUP BY 1, 2))"


def _typed():
    best = f"greatest({', '.join(_KINDS)})"
    return f"typed AS (SELECT {_K}, CASE WHEN {best} > 0 THEN CASE {best} {' '.join(f'''WHEN {t} THEN '{t}' ''' for t in _KINDS)} END ELSE 'unknown' END AS type, {best} AS confidence FROM {_scores()})"


@query("c24_c27_rule_types", f"WITH {_NULLS}, {_typed()} SELECT * FROM typed")
def rule_types(spark, sf):
    return P.rule_types(values(spark, sf))


def _share(p):
    return f"avg(regexp_matches(value, '{p}')::INT) > 0.8"


_VOTES = f"votes AS (SELECT {_K}, CASE WHEN {_share(K.VALUE_PATTERNS['ipv4'])} THEN 1 WHEN {_share('@')} THEN 2 WHEN {_share('^[0-9]{4}-[0-9]{2}-[0-9]{2}')} THEN 3 WHEN {_share('^[0-9]+$')} THEN 4 WHEN contains({_L}, 'host') THEN 0 ELSE -1 END AS vote FROM v GROUP BY 1, 2)"


@query("c25_votes", f"WITH {_VALUES}, {_VOTES} SELECT * FROM votes")
def votes(spark, sf):
    return P.votes(values(spark, sf)).select(*P.KEYS, "vote")


def _hinted():
    """The type that a column's name hints at, with its floor."""
    fits = [("(" + " OR ".join(f"contains({_L}, '{w}')" for w in words) + ")", kind, value) for words, kind, value in K.NAME_HINTS]
    return f"CASE {' '.join(f"WHEN {f} THEN '{k}'" for f, k, _ in fits)} ELSE 'unknown' END AS type, CASE {' '.join(f'WHEN {f} THEN {x}::DOUBLE' for f, _, x in fits)} ELSE 0::DOUBLE END AS confidence"


_SHARES = [(t, f"avg(regexp_matches(value, '{K.VALUE_PATTERNS[p]}')::INT)") for t, p in P.SHAPE_TYPES.items()]
_TOP = f"greatest({', '.join(f'x{k}' for k in range(len(_SHARES)))})"
_PREDICTIONS = f"""{_typed()}, voted AS (SELECT {_K}, vote, CASE vote WHEN 1 THEN ip WHEN 2 THEN mail WHEN 3 THEN date WHEN 4 THEN digits WHEN 0 THEN 0.5::DOUBLE ELSE 0::DOUBLE END AS share FROM votes JOIN (SELECT {_K}, avg(regexp_matches(value, '{K.VALUE_PATTERNS['ipv4']}')::INT) AS ip, avg(contains(value, '@')::INT) AS mail, avg(regexp_matches(value, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')::INT) AS date, avg(regexp_matches(value, '^[0-9]+$')::INT) AS digits FROM v GROUP BY 1, 2) USING (table_name, column_name)),
shaped AS (SELECT {_K}, {', '.join(f'{x} AS x{k}' for k, (_, x) in enumerate(_SHARES))} FROM v GROUP BY 1, 2),
preds AS (SELECT table_name || '.' || column_name AS c, 'llm' AS model, type, confidence FROM typed
  UNION ALL SELECT table_name || '.' || column_name, 'doduo', CASE vote {' '.join(f"WHEN {k} THEN '{t}'" for k, t in P.VOTED.items())} ELSE 'unknown' END, share FROM voted
  UNION ALL SELECT table_name || '.' || column_name, 'sherlock', CASE WHEN {_TOP} > 0 THEN CASE {_TOP} {' '.join(f"WHEN x{k} THEN '{t}'" for k, (t, _) in enumerate(_SHARES))} END ELSE 'unknown' END, {_TOP} FROM shaped
  UNION ALL SELECT c, 'sato', type, confidence FROM (SELECT table_name || '.' || column_name AS c, {_hinted()} FROM (SELECT DISTINCT {_K} FROM v)))"""


@query("c19_predictions", f"WITH {_VALUES}, {_VOTES}, {_PREDICTIONS} SELECT c AS column_name, model, type, round(confidence, 9) AS confidence FROM preds")
def predictions(spark, sf):
    return P.predictions(values(spark, sf)).withColumn("confidence", F.round("confidence", 9))


@query("c26_ensemble", f"""WITH {_VALUES}, {_VOTES}, {_PREDICTIONS},
sums AS (SELECT c, type, sum(CASE model {' '.join(f"WHEN '{m}' THEN {w}::DOUBLE" for m, w in K.ENSEMBLE_WEIGHTS.items())} END * confidence) AS s FROM preds GROUP BY 1, 2)
SELECT c AS column_name, arg_min(type, (-round(s, 9), type)) AS type, round(max(s), 9) AS confidence FROM sums GROUP BY 1""")
def ensemble(spark, sf):
    return P.ensemble(P.predictions(values(spark, sf)))


_SAMPLES = "samples AS (SELECT host_name AS value, row_id AS place FROM host_raw WHERE table_name = 'tpch.supplier' AND host_name IS NOT NULL UNION ALL SELECT host_name, row_id + 1000000 FROM host_raw WHERE table_name = 'web.pages')"


@query("c28_learned_patterns", f"WITH {V.RAW_SQL}, {_SAMPLES}, kinds AS (SELECT CASE WHEN contains(value, '-') THEN 'hyphenated' WHEN contains(value, '.') THEN 'fqdn' END AS type, CASE WHEN contains(value, '-') THEN len(string_split(value, '-')) ELSE len(string_split(value, '.')) END AS segments, * FROM samples) SELECT type, CAST(segments AS INT) AS segments, arg_min(value, place) AS example FROM kinds WHERE type IS NOT NULL GROUP BY 1, 2")
def learned_patterns(spark, sf):
    raw = V.raw(spark, sf)
    samples = raw.filter("table_name = 'tpch.supplier' and host_name is not null").select(F.col("host_name").alias("value"), F.col("row_id").alias("place"))
    return P.learned_patterns(samples.unionByName(raw.filter("table_name = 'web.pages' and host_name is not null").select(F.col("host_name").alias("value"), (F.col("row_id") + 1_000_000).alias("place"))))


@query("c29_associated_columns", f"WITH {_CATALOG} SELECT anchor, column_name, n, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, column_name) AS rank FROM (SELECT a.column_name AS anchor, b.column_name, count(*) AS n FROM catalog a JOIN catalog b USING (table_name) WHERE contains(a.column_name, 'name') AND a.column_name <> b.column_name GROUP BY 1, 2)) WHERE rank <= 10")
def associated_columns(spark, sf):
    c = catalog(spark, sf)
    return P.associated(c, c.filter(F.col("column_name").contains("name")))


# Scans


@query("s2_s3_sampled_scan", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY left(md5('42|' || CAST(o_orderkey AS VARCHAR)), 15) LIMIT (SELECT least(count(*) * 10 // 100, 100000) FROM orders)")
def sampled_scan(spark, sf):
    return S.sampled(table(spark, sf, "orders"), percent=10, most=100_000, seed=42, by=["o_orderkey"]).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("s3_block_sample")
def sampled_blocks(spark, sf):
    return B.block_sample(spark, f"{sf}/lineitem.parquet", percent=10, seed=7)


@query("s3_sample_size", "SELECT least(floor(count(*) * 10 / 100), 100000)::BIGINT AS n FROM orders")
def sample_size(spark, sf):
    return sampled_scan(spark, sf).agg(F.count("*").alias("n"))


@query("s4_json_projection", "SELECT vec_id, label, len(embedding) AS n FROM embeddings")
def json_projection(spark, sf):
    out = S.complex_as_json(table(spark, sf, "embeddings"))
    return out.select("vec_id", "label", F.size(F.from_json("embedding", "array<double>")).cast("long").alias("n"))


@query("s5_columnar_scan", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def columnar_scan(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("s6_nan_as_null", "SELECT event_id, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM events")
def nan_as_null(spark, sf):
    return S.nan_as_null(table(spark, sf, "events")).select("event_id", "value")


@query("s7_cast_scan", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate FROM orders ORDER BY orders.o_orderkey LIMIT 1000")
def cast_scan(spark, sf):
    return S.as_text(table(spark, sf, "orders").orderBy("o_orderkey").limit(1000)).select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("s8_minimal_scan", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer ORDER BY customer.c_custkey LIMIT 10")
def minimal_scan(spark, sf):
    return S.as_text(table(spark, sf, "customer").orderBy("c_custkey").limit(10)).select("c_custkey", "c_name", "c_nationkey")


@query("s9_scan_report", f"WITH {_CATALOG} SELECT table_name, 'metadata_only' AS scan_type, count(*) AS n_columns FROM catalog WHERE table_name <> 'host_raw' GROUP BY 1")
def scan_report(spark, sf):
    return S.report(spark, {t: table(spark, sf, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")})


_NAMED = "named AS (SELECT * FROM host_raw WHERE host_name IS NOT NULL)"


@query("s12_hostname_samples", V.with_(V.RAW_SQL, _NAMED) + f"SELECT host_name AS hostname FROM (SELECT host_name FROM named ORDER BY left(md5('7|' || table_name || '|' || CAST(row_id AS VARCHAR)), 15) LIMIT (SELECT least(count(*) * 1 // 100, 100) FROM named)) WHERE coalesce(length(host_name) BETWEEN 1 AND 253 AND NOT contains(host_name, ' ') AND regexp_matches(host_name, '{K.LOOSE_HOSTNAME}'), false)")
def hostname_samples(spark, sf):
    raw = V.raw(spark, sf)
    found = [r.column_name for r in D.find_columns(catalog(spark, sf).filter("table_name = 'host_raw'"), "hostname", 0.5).collect()]  # of one table
    return S.hostname_samples(raw, found, percent=1, seed=7, by=["table_name", "row_id"])


@query("s15_s17_files", "SELECT count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem")
def files(spark, sf):
    return S.load(spark, [f"{sf}/lineitem.parquet"]).agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query("s23_numeric_coercion", "SELECT event_id, coalesce(try_cast(event_type AS DOUBLE), 0.0)::DOUBLE AS event_type, coalesce(try_cast(user_id AS DOUBLE), 0.0)::DOUBLE AS user_id FROM events")
def numeric_coercion(spark, sf):
    return S.numeric(table(spark, sf, "events").select("event_id", "event_type", "user_id"), ["event_type", "user_id"])
