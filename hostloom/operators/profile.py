"""Column profiles: statistics, patterns, entropies, distributions, name features and semantic types.

Wide tables are turned into long rows (table, column, place, value) first; every profile is then one
aggregation with partial sums, whatever the number of columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import host as H

KEYS = ["table_name", "column_name"]
#: Sampled values of a column.
SAMPLES = 100


def long_rows(df: DataFrame, table: str, order: Column, columns: list[str]) -> DataFrame:
    """Rows table_name, column_name, place, value: the first SAMPLES rows by order, as text."""
    rows = df.select(order.alias("\x00o"), *columns).orderBy("\x00o").limit(SAMPLES)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")
    return rows.select(F.lit(table).alias("table_name"), F.col("\x00o").alias("place"), each).select("table_name", "x.column_name", "place", "x.value")


def filled(values: DataFrame) -> DataFrame:
    """Null values as empty text."""
    return values.withColumn("value", F.coalesce("value", F.lit("")))


def statistics(values: DataFrame) -> DataFrame:
    """Distinct non-empty values (zero and false don't count), null or empty ones, all, and up to ten samples."""
    truthy = F.when(~F.coalesce("value", F.lit("")).isin("", "0", "0.0", "false"), F.col("value"))
    return values.groupBy(*KEYS).agg(
        F.count_distinct(truthy).alias("unique_count"),
        F.count_if(F.coalesce("value", F.lit("")) == "").alias("null_count"),
        F.count("*").alias("total_count"),
        F.slice(F.array_sort(F.collect_set(truthy)), 1, 10).alias("sample_values"),
    )


def lengths(values: DataFrame) -> DataFrame:
    """Statistics of lengths and of the values that are numbers."""
    n, x = F.length("value"), F.col("value").try_cast("double")
    pct = lambda p: F.percentile(n, p)
    sizes = filled(values).groupBy(*KEYS, n.alias("len")).agg(F.count("*").alias("k")).groupBy(*KEYS).agg(F.max("k").alias("mode_count"))
    return (
        filled(values)
        .groupBy(*KEYS)
        .agg(
            F.avg(n).alias("mean"), F.median(n).alias("median"), F.stddev_pop(n).alias("std"), F.var_pop(n).alias("var"), F.min(n).alias("min"), F.max(n).alias("max"), (F.max(n) - F.min(n)).alias("range"),
            pct(0.1).alias("p10"), pct(0.25).alias("p25"), pct(0.75).alias("p75"), pct(0.9).alias("p90"), F.count_distinct(n).alias("n_lengths"), F.count_if(n == 0).alias("n_empty"),
            (F.count_distinct("value") / F.count("*")).alias("unique_ratio"), (F.count_if(F.col("value") == "") / F.count("*")).alias("null_ratio"),
            F.avg(x).alias("num_mean"), F.stddev_pop(x).alias("num_std"), F.min(x).alias("num_min"), F.max(x).alias("num_max"), (F.count(x) / F.count("*")).alias("num_ratio"),
        )
        .join(sizes, KEYS)
    )


def pattern_shares(values: DataFrame, names: list[str]) -> DataFrame:
    """The share of values that fit each pattern, all in one pass."""
    return filled(values).groupBy(*KEYS).agg(*(F.avg(F.col("value").rlike(K.VALUE_PATTERNS[n]).cast("double")).alias(n) for n in names))


CHARACTER_CLASSES = {"alpha": r"\p{L}", "digit": r"\p{Nd}", "space": r"\s", "upper": r"\p{Lu}", "lower": r"\p{Ll}", "dots": r"._\-", "signs": r"@#$%", "brackets": r"()\[\]{}", "slashes": r"/\\|", "commas": r",:;", "non_ascii": r"^\x00-\x7F"}


def character_shares(values: DataFrame, classes: dict[str, str] = CHARACTER_CLASSES) -> DataFrame:
    """Shares of character classes in all values together; null where there is no character."""
    total = F.sum(F.length("value"))
    left = lambda c: F.sum(F.length(F.regexp_replace("value", f"[{c}]", "")))
    return filled(values).groupBy(*KEYS).agg(*(((total - left(c)) / F.nullif(total, F.lit(0))).alias(n) for n, c in classes.items()))


SPECIAL = list("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~ \t")


def special_frequencies(values: DataFrame) -> DataFrame:
    """Frequencies of 34 characters, of letters and digits, and of other than ASCII."""
    total = F.nullif(F.sum(F.length("value")), F.lit(0))
    counts = [(F.sum(F.length("value") - F.length(F.replace("value", F.lit(c), F.lit("")))) / total).alias(f"c{ord(c)}") for c in SPECIAL]
    return filled(values).groupBy(*KEYS).agg(*counts, (F.sum(F.length(F.regexp_replace("value", r"[^\p{L}\p{Nd}]", ""))) / total).alias("alnum"))


def _entropy(counted: DataFrame) -> DataFrame:
    total = F.sum("k").over(Window.partitionBy(*KEYS))
    p = F.col("k") / F.col("t")
    return counted.withColumn("t", total).groupBy(*KEYS).agg(F.sum(p * F.log2(1 / p)).alias("entropy"))


def grams(values: DataFrame, n: int, joined: str | None = "") -> DataFrame:
    """Rows of keys and gram: of each value by itself, or of all values of a column joined in order, SAMPLES at most."""
    if joined is None:
        text = F.col("value")
        rows = filled(values)
    else:
        rows = filled(values).groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]), joined).alias("value"))
        text = F.col("value")
    upto = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return rows.select(*KEYS, text.alias("v"), F.explode(upto).alias("at")).select(*KEYS, F.expr(f"substring(v, at, {n})").alias("gram"))


def gram_entropy(values: DataFrame, n: int) -> DataFrame:
    return _entropy(grams(values, n, None if n == 1 else "").groupBy(*KEYS, "gram").agg(F.count("*").alias("k")))


def top_grams(values: DataFrame, n: int, top: int = 10) -> DataFrame:
    """Relative frequencies of the most frequent grams of the values joined by spaces."""
    counted = grams(values, n, " ").groupBy(*KEYS, "gram").agg(F.count("*").alias("k"))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("k"), "gram"))
    total = F.sum("k").over(Window.partitionBy(*KEYS))
    return counted.select(*KEYS, rank.alias("rank"), (F.col("k") / total).alias("share")).filter(F.col("rank") <= top)


def value_frequencies(values: DataFrame) -> DataFrame:
    """Largest, least and mean count of a value, their deviation, the share of the top ten, entropy and Gini coefficient."""
    counted = filled(values).groupBy(*KEYS, "value").agg(F.count("*").alias("k"))
    up = F.row_number().over(Window.partitionBy(*KEYS).orderBy("k", "value"))
    down = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("k"), F.desc("value")))
    ranked = counted.withColumns({"up": up, "down": down, "t": F.sum("k").over(Window.partitionBy(*KEYS))})
    n, total, p = F.count("*"), F.sum("k"), F.col("k") / F.col("t")
    return ranked.groupBy(*KEYS).agg(
        F.max("k").alias("max"), F.min("k").alias("min"), F.avg("k").alias("mean"), F.stddev_pop("k").alias("std"), (F.sum(F.when(F.col("down") <= 10, F.col("k")).otherwise(0)) / total).alias("top10"),
        (2 * F.sum(F.col("up") * F.col("k")) / (n * total) - (n + 1) / n).alias("gini"), F.sum(p * F.log2(1 / p)).alias("entropy"), (n / total).alias("uniqueness"),
    )


def length_entropy(values: DataFrame) -> DataFrame:
    return _entropy(filled(values).groupBy(*KEYS, F.length("value").alias("len")).agg(F.count("*").alias("k")))


def name_features(catalog: DataFrame, words: list[str]) -> DataFrame:
    """0 or 1 for each substring of a column's name, and its shape."""
    name, c = F.lower("column_name"), F.col("column_name")
    flag = lambda x: x.cast("int")
    count = lambda s: F.length(c) - F.length(F.replace(c, F.lit(s), F.lit("")))
    shape = {
        "len": F.length(c), "underscores": count("_"), "hyphens": count("-"), "dots": count("."), "is_upper": flag((F.upper(c) == c) & c.rlike("[A-Za-z]")), "is_lower": flag((name == c) & c.rlike("[A-Za-z]")),
        "first_upper": flag(c.rlike("^[A-Z]")), "has_digit": flag(c.rlike(r"\d")), "snake": flag(c.contains("_")), "camel": flag(c.rlike("^[a-z].*[A-Z]")), "pascal": flag(c.rlike("^[A-Z].*[A-Z]")),
    }
    found = F.array(*(flag(name.contains(w)) for w in words))
    return catalog.select("table_name", "column_name", found.alias("words"), *(v.alias(k) for k, v in shape.items()))


def feature_vector(parts: list[Column], size: int = 1588) -> Column:
    """All parts one after the other, filled up with zeros or cut to size."""
    return F.slice(F.concat(*(F.transform(p, lambda x: x.cast("double")) for p in parts), F.array_repeat(F.lit(0.0), size)), 1, size)


def tf_idf(docs: DataFrame, top: int = 500) -> DataFrame:
    """Rows id, word, score for the top words by document frequency: count over length, times ln(N / (df + 1)). The texts are split
    twice, so that only rows of the top words are ever shuffled by text."""
    rows = docs.select("id", F.regexp_extract_all(F.lower("text"), F.lit(r"(\w+)")).alias("w"))
    df = rows.select(F.explode(F.array_distinct("w")).alias("word")).groupBy("word").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "word").limit(top)
    n = docs.agg(F.count("*").alias("n"))  # one row
    counts = rows.select("id", F.size("w").alias("len"), F.explode("w").alias("word")).join(F.broadcast(df), "word").groupBy("id", "len", "word", "df").agg(F.count("*").alias("k"))
    return counts.crossJoin(n).select("id", "word", (F.col("k") / F.col("len") * F.log(F.col("n") / (F.col("df") + 1))).alias("score"))


def top_words(docs: DataFrame, top: int) -> DataFrame:
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\w+)"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def serialised(values: DataFrame) -> DataFrame:
    """One line a table: its columns by name, eight values each, 2048 characters at most."""
    first = Window.partitionBy(*KEYS).orderBy("place")
    kept = filled(values).withColumn("rn", F.row_number().over(first)).filter("rn <= 8")
    lines = kept.groupBy(*KEYS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]), " | ").alias("v"))
    lines = lines.select("table_name", "column_name", F.concat(F.lit("[COL] "), "column_name", F.lit(" [VAL] "), "v").alias("line"))
    every = F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("column_name", "line"))), 1, 50), lambda x: x["line"]), " ")
    return lines.groupBy("table_name").agg(F.substring(every, 1, 2048).alias("text"))


def token_count(text: Column, most: int = 512) -> Column:
    """Words and single punctuation marks, with two marks at the ends, at most."""
    return F.least(F.size(F.regexp_extract_all(F.lower(text), F.lit(r"(\w+|[^\w\s])"))) + 2, F.lit(most))


def rule_scores(values: DataFrame) -> DataFrame:
    """The score of each semantic type for each column, by value patterns and name hints: a column a type."""
    rows = values.filter("value is not null").withColumn("value", F.trim("value"))
    name = F.lower("column_name")
    shares = {t: [F.avg(F.col("value").rlike(f"(?i){p}").cast("double")) * w for p, w in ps] for t, ps in K.TYPE_PATTERNS.items()}
    scored = rows.groupBy(*KEYS).agg(*((F.greatest(*s) if len(s) > 1 else s[0]).alias(t) for t, s in shares.items()))
    hint, taken = {}, F.lit(False)
    for words, kind, floor in K.NAME_HINTS:
        fits = H.any_contains(name, list(words))
        hint[kind] = F.when(fits & ~taken, floor).otherwise(0.0)
        taken = taken | fits
    return scored.select(*KEYS, *(F.round(F.greatest(F.col(t), hint[t]) if t in hint else F.col(t), 9).alias(t) for t in K.TYPE_PATTERNS))


def rule_types(values: DataFrame) -> DataFrame:
    """The semantic type of each column by value patterns and name hints; the first one of equals."""
    kinds = list(K.TYPE_PATTERNS)
    best = F.greatest(*kinds)
    kind = reduce(lambda out, t: F.when(F.col(t) == best, t).otherwise(out), reversed(kinds), F.lit("unknown"))
    return rule_scores(values).select(*KEYS, F.when(best > 0, kind).otherwise("unknown").alias("type"), best.alias("confidence"))


def votes(values: DataFrame) -> DataFrame:
    """A labelling function's vote: 1 address, 2 mail, 3 date, 4 digits, 0 host by name, -1 none."""
    share = lambda p: F.avg(F.col("value").rlike(p).cast("double"))
    rows = filled(values).groupBy(*KEYS).agg(share(K.VALUE_PATTERNS["ipv4"]).alias("ip"), share("@").alias("at"), share(r"^\d{4}-\d{2}-\d{2}").alias("date"), share(r"^\d+$").alias("digits"))
    vote = F.when(F.col("ip") > 0.8, 1).when(F.col("at") > 0.8, 2).when(F.col("date") > 0.8, 3).when(F.col("digits") > 0.8, 4).when(F.lower("column_name").contains("host"), 0).otherwise(-1)
    return rows.select(*KEYS, vote.alias("vote"), "ip", "at", "date", "digits")


#: Types by labelling functions' votes, and by patterns of values, in order.
VOTED = {1: "ip_address", 2: "email", 3: "timestamp", 4: "numeric_id", 0: "hostname"}
SHAPE_TYPES = {"ip_address": "ipv4", "email": "email", "url": "url", "timestamp": "datetime_iso", "phone": "phone_us", "numeric_id": "zip_us", "hostname": "hostname"}


def predictions(values: DataFrame) -> DataFrame:
    """column_name, model, type, confidence of the four voters of the ensemble. Three of them are networks of random weights
    in the survey; deterministic judges stand in for them: shares of value patterns (sherlock), hints in the column's
    name (sato), labelling functions with their shares (doduo); the fourth is the rule classifier (llm)."""
    name, low = F.concat_ws(".", *KEYS).alias("column_name"), F.lower("column_name")
    out = rule_types(values).select(name, F.lit("llm").alias("model"), "type", "confidence")
    first = lambda rules, default: reduce(lambda out, x: F.when(x[0], x[1]).otherwise(out), reversed(rules), F.lit(default))
    voted = votes(values)
    shares = {1: "ip", 2: "at", 3: "date", 4: "digits"}
    share = first([*((F.col("vote") == k, F.col(c)) for k, c in shares.items()), (F.col("vote") == 0, 0.5)], 0.0)
    out = out.unionByName(voted.select(name, F.lit("doduo").alias("model"), first([(F.col("vote") == k, t) for k, t in VOTED.items()], "unknown").alias("type"), share.alias("confidence")))
    shaped = filled(values).groupBy(*KEYS).agg(*(F.avg(F.col("value").rlike(K.VALUE_PATTERNS[p]).cast("double")).alias(t) for t, p in SHAPE_TYPES.items()))
    best = F.greatest(*SHAPE_TYPES)
    out = out.unionByName(shaped.select(name, F.lit("sherlock").alias("model"), F.when(best > 0, first([(F.col(t) == best, t) for t in SHAPE_TYPES], "unknown")).otherwise("unknown").alias("type"), best.alias("confidence")))
    hints = [(H.any_contains(low, list(words)), kind, floor) for words, kind, floor in K.NAME_HINTS]
    hinted = values.select(*KEYS).distinct().select(name, F.lit("sato").alias("model"), first([(f, k) for f, k, _ in hints], "unknown").alias("type"), first([(f, x) for f, _, x in hints], 0.0).alias("confidence"))
    return out.unionByName(hinted)


def ensemble(predictions: DataFrame, weights: dict[str, float] = K.ENSEMBLE_WEIGHTS) -> DataFrame:
    """predictions: column_name, model, type, confidence. The type of the highest weighted sum."""
    weight = reduce(lambda out, x: F.when(F.col("model") == x[0], x[1]).otherwise(out), weights.items(), F.lit(0.0))
    sums = predictions.groupBy("column_name", "type").agg(F.sum(weight * F.col("confidence")).alias("score"))
    return sums.groupBy("column_name").agg(F.min_by("type", F.struct(-F.round("score", 9), "type")).alias("type"), F.round(F.max("score") / sum(weights.values()), 9).alias("confidence"))


def learned_patterns(samples: DataFrame) -> DataFrame:
    """samples: value, place. Kinds of host names by hyphens or dots and the number of segments, with the first example."""
    kind = F.when(F.col("value").contains("-"), "hyphenated").when(F.col("value").contains("."), "fqdn")
    size = F.when(kind == "hyphenated", F.size(F.split("value", "-"))).otherwise(F.size(F.split("value", r"\.")))
    return samples.select(kind.alias("type"), size.alias("segments"), "value", "place").filter("type is not null").groupBy("type", "segments").agg(F.min_by("value", "place").alias("example"))


def associated(catalog: DataFrame, anchors: DataFrame, top: int = 10) -> DataFrame:
    """The columns that most often share a table with each anchor column."""
    pairs = anchors.select("table_name", F.col("column_name").alias("anchor")).join(catalog.select("table_name", "column_name"), "table_name").filter("column_name <> anchor")
    counted = pairs.groupBy("anchor", "column_name").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("n"), "column_name"))
    return counted.withColumn("rank", rank).filter(F.col("rank") <= top)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """Counts of hashed character trigrams: the deterministic stand-in where a model would embed a text."""
    padded = F.concat(F.lit("^"), F.lower(text), F.lit("$"))
    upto = F.when(F.length(padded) >= 3, F.sequence(F.lit(1), F.length(padded) - 2)).otherwise(F.array().cast("array<int>"))
    slots = F.transform(upto, lambda k: F.conv(F.substring(F.md5(F.substr(padded, k, F.lit(3))), 1, 8), 16, 10).cast("long") % size)
    # one pass over the slots: a filter for each place would hash the text's trigrams as often
    one = F.lit(1.0).cast("float")
    return F.aggregate(slots, F.array_repeat(F.lit(0.0).cast("float"), size), lambda counts, s: F.transform(counts, lambda x, i: F.when(i == s, x + one).otherwise(x)))


def relation(a: DataFrame, b: DataFrame, share: float = 0.95) -> DataFrame:
    """One row for two columns: distinct values, those shared, and the relation. same_entity: each holds the other's values;
    foreign_key: b holds a's; hierarchical: a holds b's; else none. A deterministic test where the survey has a network."""
    a, b = a.select(F.col(a.columns[0]).cast("string").alias("v")).dropna().distinct(), b.select(F.col(b.columns[0]).cast("string").alias("v")).dropna().distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), "v", "full").agg(F.count("a").alias("n"), F.count("b").alias("m"), F.count(F.col("a") + F.col("b")).alias("shared"))
    inside, holds = F.col("shared") >= F.col("n") * share, F.col("shared") >= F.col("m") * share
    return both.select("n", "m", "shared", F.when(inside & holds, "same_entity").when(inside, "foreign_key").when(holds, "hierarchical").otherwise("none").alias("relation"))


def topics(docs: DataFrame, k: int = 16, vocabulary: int = 500, seed: int = 42) -> DataFrame:
    """id, topics: shares of k topics of the words of each text, by latent Dirichlet allocation with a fixed seed."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    words = docs.select("id", F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(\w+)")).alias("words"))
    counts = CountVectorizer(inputCol="words", outputCol="counts", vocabSize=vocabulary).fit(words).transform(words)
    model = LDA(k=k, seed=seed, maxIter=5, featuresCol="counts").fit(counts)
    return model.transform(counts).select("id", vector_to_array("topicDistribution").alias("topics"))
