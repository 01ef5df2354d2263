"""Queries: types of columns by a trained classifier, by decoding over tables and by a label model; all rows of all tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import profile as P
from ..operators import types as M
from ..operators.lineage import cut
from ..sources.inventory import DERIVED, derived, table
from . import views as V
from .column_queries import _KINDS, _NULLS, _PREDICTIONS, _VOTES, _scores, _typed, values
from .registry import query

#: Tables of plain columns, whose values are the same text in both engines; and those that the classifier reads beside them.
PLAIN = ["region", "nation", "customer", "supplier", "part", "orders", "events", *DERIVED]
MORE = ["pages", "documents", "conversations"]
#: Columns whose type is known.
LABELS = {
    "customer": {"c_custkey": "identifier", "c_name": "name", "c_acctbal": "amount", "c_mktsegment": "category"},
    "supplier": {"s_suppkey": "identifier", "s_name": "name", "s_acctbal": "amount"},
    "part": {"p_partkey": "identifier", "p_brand": "category", "p_type": "category", "p_size": "quantity", "p_retailprice": "amount"},
    "orders": {"o_orderkey": "identifier", "o_custkey": "identifier", "o_orderstatus": "category", "o_totalprice": "amount", "o_orderdate": "timestamp", "o_orderpriority": "category"},
    "events": {"event_id": "identifier", "ts": "timestamp", "user_id": "identifier", "event_type": "category", "value": "amount", "props": "json"},
    "host_raw": {"host_name": "hostname", "ip_address": "ip_address", "environment": "category", "os_type": "category", "cpu_cores": "quantity", "memory_gb": "quantity", "last_seen": "timestamp", "status": "category"},
    "assets": {"server_name": "hostname", "private_ip": "ip_address", "cost": "amount"},
    "dns_records": {"fqdn": "hostname", "ipv4": "ip_address"},
    "flows": {"seen_at": "hostname", "peer": "ip_address"},
    "pages": {"page_id": "identifier", "url": "url", "html": "markup"},
    "documents": {"doc_id": "identifier", "text": "text", "lang": "category", "n_chars": "quantity"},
    "conversations": {"conv_id": "identifier", "role": "category", "text": "text"},
}
TYPES = sorted({t for columns in LABELS.values() for t in columns.values()})


def sources(spark, sf, names=PLAIN):
    every = derived(spark, sf)
    return {t: every[t] if t in every else table(spark, sf, t) for t in names}


def trained(spark, sf):
    """features() of all columns by slice, and the model of the labelled ones; every fifth slice is held out."""
    rows = cut(M.features(M.values(sources(spark, sf, PLAIN + MORE), M.SLICES)))
    known = M.labelled(rows, LABELS)
    return rows, known, M.train(known.filter("slice % 5 <> 0"), TYPES)


@query("c19_trained_types")
def trained_types(spark, sf):
    rows, _, model = trained(spark, sf)
    return M.predicted(model, rows, TYPES).drop("ordinal")


_VALS = ", ".join((V.RAW_SQL, *(f"{n} AS ({t.strip()})" for n, t in DERIVED.items() if n != "host_raw"))) + ", vals AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, column_name, value FROM (SELECT row_number() OVER () AS r, COLUMNS(*)::VARCHAR FROM {t}) UNPIVOT INCLUDE NULLS (value FOR column_name IN (COLUMNS(* EXCLUDE (r))))" for t in PLAIN
) + "), v AS (SELECT table_name, column_name, coalesce(value, '') AS value FROM vals)"
_PLACES = " UNION ALL ".join(f"SELECT '{t}' AS table_name, column_name, row_number() OVER () AS ordinal FROM (DESCRIBE SELECT * FROM {t})" for t in PLAIN)
_N = len(_KINDS)
#: Each score has a hundredth added, so that no label is impossible.
_EMITTED = f"""scored AS (SELECT *, {' + '.join(_KINDS)} AS total FROM {_scores()}),
em AS MATERIALIZED (SELECT table_name, column_name, row_number() OVER (PARTITION BY table_name ORDER BY ordinal) - 1 AS k, [{', '.join(f"ln(({t} + 0.01) / (total + {_N / 100}))" for t in _KINDS)}] AS e FROM scored JOIN ({_PLACES}) USING (table_name, column_name)),
labels AS (SELECT table_name, k, list_position(e, list_max(e)) - 1 AS label FROM em),
counted AS (SELECT a.label AS i, b.label AS j, count(*) AS n FROM labels a JOIN labels b ON a.table_name = b.table_name AND b.k = a.k + 1 GROUP BY 1, 2),
steps AS MATERIALIZED (SELECT i, j, ln((coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER (PARTITION BY i) + {_N})) AS t FROM (SELECT unnest(range({_N})) AS i) CROSS JOIN (SELECT unnest(range({_N})) AS j) LEFT JOIN counted USING (i, j)),
step(table_name, k, j, best) AS (SELECT table_name, 0::BIGINT, j, {{'s': e[j + 1], 'path': [j]}} FROM em, (SELECT unnest(range({_N})) AS j) WHERE k = 0
  UNION ALL SELECT x.table_name, x.k + 1, x.j, {{'s': x.b.s + em.e[x.j + 1], 'path': list_append(x.b.path, x.j)}} FROM (
    SELECT s.table_name, s.k, t.j, max({{'s': s.best.s + t.t, 'path': s.best.path}}) AS b FROM step s JOIN steps t ON t.i = s.j GROUP BY 1, 2, 3) x JOIN em ON em.table_name = x.table_name AND em.k = x.k + 1),
done AS (SELECT s.table_name, max(best) AS b FROM step s JOIN (SELECT table_name, max(k) AS k FROM em GROUP BY 1) m USING (table_name, k) GROUP BY 1)"""


def emissions(spark, sf):
    """table_name, column_name, ordinal without gaps, e: log scores of the rule types."""
    tables = sources(spark, sf)
    places = [(t, f.name, k) for t, df in tables.items() for k, f in enumerate(df.schema)]
    total = sum((F.col(t) for t in _KINDS[1:]), F.col(_KINDS[0])) + F.lit(_N / 100)
    rows = P.rule_scores(M.values(tables)).join(F.broadcast(spark.createDataFrame(places, "table_name string, column_name string, place int")), P.KEYS)
    e = F.array(*(F.log((F.col(t) + 0.01) / total) for t in _KINDS))
    return cut(rows.select("table_name", "column_name", (F.row_number().over(Window.partitionBy("table_name").orderBy("place")) - 1).alias("ordinal"), e.alias("e")))


@query("c20_decoded_types", f"WITH RECURSIVE {_VALS}, {_EMITTED} SELECT em.table_name, em.column_name, [{', '.join(repr(t) for t in _KINDS)}][b.path[k + 1] + 1] AS type, round(b.s, 6) AS score FROM done JOIN em USING (table_name)")
def decoded_types(spark, sf):
    rows = emissions(spark, sf)
    first = rows.select("table_name", "ordinal", (F.array_position("e", F.array_max("e")) - 1).cast("int").alias("label"))
    told = M.decoded(rows, M.transitions(first, _N))
    named = F.element_at(F.array(*map(F.lit, _KINDS)), F.get("labels", F.col("ordinal")) + 1)
    return rows.join(told, "table_name").select("table_name", "column_name", named.alias("type"), F.round("score", 6).alias("score"))


@query("k23_safe_types", f"WITH {_NULLS}, {_typed()} SELECT * FROM typed")
def safe_types(spark, sf):
    """The rule types; a column that the classifier failed on would be unknown with 0."""
    return M.safely(cut(values(spark, sf)), P.rule_types)


#: Types that any of the four judges may name, and rounds that both engines do.
CLASSES, ROUNDS = len({*_KINDS, *P.VOTED.values(), *P.SHAPE_TYPES}), 10


def _rounds() -> str:
    out = ["acc0 AS (SELECT DISTINCT voter, 0.8::DOUBLE AS a FROM given)"]
    wrong = f"(1 - a) / {CLASSES - 1}"
    for r in range(ROUNDS + 1):
        out.append(f"w{r} AS MATERIALIZED (SELECT g.item, c.vote AS class, product(CASE WHEN g.vote = c.vote THEN a ELSE {wrong} END) AS w FROM given g JOIN (SELECT DISTINCT item, vote FROM given) c USING (item) JOIN acc{r} USING (voter) GROUP BY 1, 2)")
        out.append(f"z{r} AS MATERIALIZED (SELECT item, s + rest AS z FROM (SELECT item, sum(w) AS s FROM w{r} GROUP BY 1) JOIN (SELECT item, ({CLASSES} - count(DISTINCT vote)) * product({wrong}) AS rest FROM given JOIN acc{r} USING (voter) GROUP BY 1) USING (item))")
        out.append(f"acc{r + 1} AS MATERIALIZED (SELECT voter, (sum(w / z) + 1) / (count(*) + 2) AS a FROM given g JOIN w{r} w ON w.item = g.item AND w.class = g.vote JOIN z{r} z ON z.item = g.item GROUP BY 1)")
    return ",\n".join(out)


_GIVEN = f"{_VALS}, {_VOTES}, {_PREDICTIONS}, given AS MATERIALIZED (SELECT c AS item, model AS voter, type AS vote FROM preds WHERE type <> 'unknown'), {_rounds()}"


def model(spark, sf):
    votes = P.predictions(M.values(sources(spark, sf))).filter("type <> 'unknown'").select(F.col("column_name").alias("item"), F.col("model").alias("voter"), F.col("type").alias("vote"))
    return M.label_model(votes, CLASSES, ROUNDS, tolerance=0)


@query("c25_label_model", f"WITH {_GIVEN} SELECT item, arg_max(class, (round(w / z, 9), class)) AS label, round(max(w / z), 6) AS confidence, any_value(n)::INT AS n_votes FROM w{ROUNDS} JOIN z{ROUNDS} USING (item) JOIN (SELECT item, count(*) AS n FROM given GROUP BY 1) USING (item) GROUP BY 1")
def label_model(spark, sf):
    return model(spark, sf)[0].withColumn("confidence", F.round("confidence", 6))


@query("c25_voters", f"WITH {_GIVEN} SELECT voter, round(a, 6) AS accuracy FROM acc{ROUNDS}")
def voters(spark, sf):
    return spark.createDataFrame([(v, round(a, 6)) for v, a in model(spark, sf)[1].items()], "voter string, accuracy double")
