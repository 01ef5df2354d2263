"""Semantic types of columns: a trained classifier, decoding over the columns of a table, and a label model for weak labels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from .lineage import cut
from .profile import CHARACTER_CLASSES, KEYS

#: Slices of a table's rows, and the length from which on a value fits no pattern.
SLICES, LONG = 20, 256


def values(sources: dict[str, DataFrame], slices: int | None = None) -> DataFrame:
    """Rows table_name, column_name, ordinal, slice, value of all rows of all tables, values as text. A row's slice is a hash of all that it
    says (0 without slices); complex values are JSON."""
    out = None
    for table, df in sources.items():
        text = lambda f: F.to_json(f"`{f.name}`") if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`").cast("string")
        told = [text(f) for f in df.schema]
        part = F.pmod(F.xxhash64(*told), F.lit(slices)).cast("int") if slices else F.lit(0)
        each = F.explode(F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.lit(k).alias("ordinal"), told[k].alias("value")) for k, f in enumerate(df.schema)))).alias("x")
        rows = df.select(F.lit(table).alias("table_name"), part.alias("slice"), each).select("table_name", "x.column_name", "x.ordinal", "slice", "x.value")
        out = rows if out is None else out.unionByName(rows)
    return out


# A trained classifier


def features(values: DataFrame) -> DataFrame:
    """Per column and slice a vector of what its values look like: shares of patterns, of kinds of characters, of numbers, long and empty
    values, lengths, and how many are different. One aggregation with partial sums over all rows."""
    v, n = F.coalesce("value", F.lit("")), F.count("*")
    size, x = F.length(v), v.try_cast("double")
    short = size <= LONG
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    chars = F.sum(size)
    kinds = [F.coalesce(F.sum(size - F.length(F.regexp_replace(v, f"[{c}]", ""))) / F.nullif(chars, F.lit(0)), F.lit(0.0)) for c in CHARACTER_CLASSES.values()]
    shape = [share(~short), share(v == ""), share(x.isNotNull()), F.log1p(F.avg(size)), F.log1p(F.coalesce(F.stddev_pop(size), F.lit(0.0))), F.log1p(F.max(size)), F.approx_count_distinct(v) / n, share(x % 1 == 0), share(v.contains(" "))]
    found = F.array(*(share(short & v.rlike(p)) for p in K.VALUE_PATTERNS.values()), *kinds, *shape)
    return values.groupBy(*KEYS, "ordinal", "slice").agg(n.alias("n"), found.alias("features"))


def train(rows: DataFrame, types: list[str], weight: float = 1e-3) -> LogisticRegressionModel:
    """A multinomial regression on features() rows with a type among types. Each row is the column seen in one slice of its table. The fit
    has no chance in it, so the same rows give the same model but for the order of sums."""
    place = F.array_position(F.array(*map(F.lit, types)), F.col("type")) - 1
    data = rows.select(place.cast("double").alias("label"), array_to_vector("features").alias("features"))
    return LogisticRegression(family="multinomial", regParam=weight, maxIter=200, tol=1e-8).fit(data)


def predicted(model: LogisticRegressionModel, rows: DataFrame, types: list[str]) -> DataFrame:
    """Per column of features() rows: type, confidence and probabilities in the order of types, the mean over the column's slices."""
    scored = model.transform(rows.withColumn("features", array_to_vector("features"))).select(*KEYS, "ordinal", vector_to_array("probability").alias("p"))
    mean = F.array(*(F.avg(F.col("p")[k]) for k in range(len(types))))
    told = scored.groupBy(*KEYS, "ordinal").agg(mean.alias("probabilities"))
    best = F.array_max("probabilities")
    return told.select(*KEYS, "ordinal", F.element_at(F.array(*map(F.lit, types)), F.array_position("probabilities", best).cast("int")).alias("type"), best.alias("confidence"), "probabilities")


def labelled(rows: DataFrame, labels: dict[str, dict[str, str]]) -> DataFrame:
    """features() rows of the columns of known type, with it. labels: by table and column, a small table of its own."""
    known = [(t, c, kind) for t, columns in labels.items() for c, kind in columns.items()]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(known, "table_name string, column_name string, type string")), KEYS)


# Decoding


def transitions(labels: DataFrame, n: int) -> list[list[float]]:
    """Logarithms of how often a label follows another in the columns of tables, each pair counted once more. labels: table_name, ordinal,
    label from 0 to n - 1. The result has n x n entries, however many tables there are."""
    own = labels.select("table_name", "ordinal", "label")
    after = own.select("table_name", (F.col("ordinal") - 1).alias("ordinal"), F.col("label").alias("next"))
    count = {(r.label, r.next): r["count"] for r in own.join(after, ["table_name", "ordinal"]).groupBy("label", "next").count().collect()}
    total = [sum(count.get((i, j), 0) for j in range(n)) for i in range(n)]
    return [[math.log((count.get((i, j), 0) + 1) / (total[i] + n)) for j in range(n)] for i in range(n)]


def decoded(emissions: DataFrame, steps: list[list[float]]) -> DataFrame:
    """The most likely labels of each table's columns together (Viterbi): table_name, score, labels in the columns' order.

    emissions: table_name, ordinal (without gaps), e (an array of log scores by label). steps: log scores of one label after another.
    Of equal scores the larger path goes first. One fold over the array of a table's columns, of which a schema has thousands at most.
    """
    n = len(steps)
    table = F.array(*(F.array(*(F.lit(steps[i][j]) for i in range(n))) for j in range(n)))  # by the later label
    columns = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "e"))), lambda x: x["e"])
    told = emissions.groupBy("table_name").agg(columns.alias("e"))

    def entry(score: Column, path: Column) -> Column:
        return F.struct(score.alias("score"), path.alias("path"))

    def step(state: Column, e: Column) -> Column:
        def best(scores: Column, j: Column) -> Column:
            top = F.array_max(F.zip_with(state, scores, lambda s, t: entry(s["score"] + t, s["path"])))
            return entry(top["score"] + F.get(e, j), F.concat(top["path"], F.array(j)))

        return F.transform(table, best)

    first = F.transform(F.col("e")[0], lambda x, j: entry(x, F.array(j)))
    final = F.array_max(F.aggregate(F.slice("e", 2, F.size("e")), first, step))
    return told.select("table_name", final.alias("x")).select("table_name", "x.score", F.col("x.path").alias("labels"))


# A label model


def label_model(votes: DataFrame, classes: int, rounds: int = 100, tolerance: float = 1e-9, start: float = 0.8) -> tuple[DataFrame, dict[str, float]]:
    """Weak labels of several voters made one: per item the label of the highest posterior and that, and the voters' accuracies.

    votes: item, voter, vote (a class; voters that abstain have no row). A voter is right with a probability of its own and otherwise names
    each of the other classes alike; expectation (posteriors of the classes) and maximisation (accuracies, with one vote more of each kind)
    alternate until no accuracy changes by more than tolerance, or for rounds. The items' votes are gathered once, an array of a vote a voter;
    each round is one aggregation over them with a row a voter as its result.
    """
    items = cut(votes.dropna().groupBy("item", "voter").agg(F.min("vote").alias("vote")).groupBy("item").agg(F.array_sort(F.collect_list(F.struct("voter", "vote"))).alias("votes")))
    voters = sorted(r[0] for r in items.select(F.explode("votes.voter").alias("v")).distinct().collect())  # voters are few
    right = {v: start for v in voters}
    for _ in range(rounds if voters else 0):
        scored = _posteriors(items, right, classes)
        each = scored.select(F.explode("votes").alias("v"), "posterior").select("v.voter", F.element_at("posterior", F.col("v.vote")).alias("p"))
        after = {r.voter: r.a for r in each.groupBy("voter").agg(((F.sum("p") + 1) / (F.count("*") + 2)).alias("a")).collect()}
        change = max(abs(after[v] - right[v]) for v in voters)
        right = after
        if change <= tolerance:
            break
    best = F.array_max(F.transform(F.map_entries("posterior"), lambda x: F.struct(F.round(x["value"], 9).alias("p"), x["key"].alias("label"))))
    out = _posteriors(items, right, classes).select("item", best.alias("x"), F.size("votes").alias("n_votes"))
    return out.select("item", "x.label", F.col("x.p").alias("confidence"), "n_votes"), right


def _posteriors(items: DataFrame, right: dict[str, float], classes: int) -> DataFrame:
    """items with posterior, a map of the classes that have votes; the rest of the probability is that of classes without any."""
    good = F.create_map(*(F.lit(x) for v, a in right.items() for x in (v, a))) if right else F.lit(None).cast("map<string,double>")
    wrong = lambda v: (1 - F.element_at(good, v["voter"])) / (classes - 1)
    named = F.array_distinct(F.transform("votes", lambda v: v["vote"]))
    weight = F.transform(named, lambda c: F.aggregate("votes", F.lit(1.0), lambda s, v: s * F.when(v["vote"] == c, F.element_at(good, v["voter"])).otherwise(wrong(v))))
    rest = (classes - F.size(named)) * F.aggregate("votes", F.lit(1.0), lambda s, v: s * wrong(v))
    rows = items.withColumns({"\0named": named, "\0weight": weight, "\0rest": rest})
    total = F.aggregate("\0weight", F.col("\0rest"), lambda s, x: s + x)
    return rows.select("item", "votes", F.map_from_arrays("\0named", F.transform("\0weight", lambda x: x / total)).alias("posterior"))


def safely(values: DataFrame, classify) -> DataFrame:
    """classify(values), a type and confidence for each column; a column that it fails on becomes unknown with 0. Columns are tried together,
    and by themselves only where that fails, so a failing one costs no others theirs."""
    keys = [tuple(r) for r in values.select(*KEYS).distinct().collect()]  # a row a column
    spark = values.sparkSession

    def tried(some: list[tuple[str, str]]) -> list[DataFrame]:
        own = reduce(lambda a, b: a | b, ((F.col("table_name") == t) & (F.col("column_name") == c) for t, c in some))
        try:
            return [cut(classify(values.filter(own)).select(*KEYS, "type", F.col("confidence").cast("double").alias("confidence")))]
        except Exception:  # noqa: BLE001  whatever a classifier fails on
            if len(some) == 1:
                return [spark.createDataFrame([(*some[0], "unknown", 0.0)], "table_name string, column_name string, type string, confidence double")]
            return tried(some[: len(some) // 2]) + tried(some[len(some) // 2 :])

    empty = spark.createDataFrame([], "table_name string, column_name string, type string, confidence double")
    return reduce(DataFrame.unionByName, tried(keys), empty) if keys else empty
