"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive bytes, the most significant first. A digit of the radix is a run
of bytes whose width grows from round to round, so that the number of rounds is logarithmic in the
longest text. A group leaves the recursion as soon as it is a singleton or its texts have ended;
what is left at the end are groups of equal texts, with no digest compared anywhere.

Each round counts (group, digit) with map-side partial aggregation and joins the counts back, so a
group with a third of all rows is never gathered in one task: its rows meet one row of counts in an
equi-join that adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .sieve import sifted

NULL_ID = (1 << 63) - 1


def normalised(text):
    """The text with each run of ASCII white space as one space; null counts as empty."""
    # one lone space is already what it should be: matching only what changes spares the copying
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 128, growth: int = 16) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white-space normalisation. keep_id is the smallest id of
    the group. A null text is an empty text, and all empty texts are one group. A null id sorts
    after every other id; keep_id is null only where all ids of the group are. Rows that repeat the
    id that stays are all kept=true: an id is one document. An empty table gives an empty result.
    Columns other than the two named ones are not read.

    width: bytes of the first digit; growth: factor from a round's width to the next one's.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    text = normalised(F.col("text")).cast("binary")
    # Round 0: the digit is the length and the first bytes; the length is what tells ended from not ended.
    first = scratch.cut(
        docs.select("id", text.alias("b")).select("id", F.octet_length("b").alias("len"), F.substring("b", 1, width).alias("digit"), F.unhex(F.sha2("b", 256)).alias("sha"))
    )
    # counts are written before they are joined: rows and counts then meet in a shuffle of their own, whose hot keys are split
    groups = scratch.cut(first.groupBy("len", "digit").agg(F.min("id").alias("group"), F.count("*").alias("n")).filter("n > 1"))
    joined = first.join(groups, ["len", "digit"])
    ended = [scratch.cut(joined.filter(F.col("len") <= width).select("id", "sha", "group", "n").dropDuplicates(["id", "sha"]))]
    alive = scratch.cut(joined.filter(F.col("len") > width).select("id", "len", "digit", "sha", "group").dropDuplicates(["id", "sha"]))
    rest = scratch.cut(
        sifted(docs, alive, "id")  # only texts that may go on are shuffled
        .join(alive.hint("merge"), "id")
        .select("id", text.alias("b"), "len", "digit", "sha", "group")
        .filter((F.octet_length("b") == F.col("len")) & (F.substring("b", 1, width) == F.col("digit")))
        .select("id", "sha", "group", F.expr(f"substring(b, {width + 1})").alias("rest"))
    )
    # Further rounds: what is left of each text gets shorter, and only groups of two or more go on.
    while not rest.isEmpty():
        width *= growth
        digits = rest.withColumns({"digit": F.substring("rest", 1, width), "rest": F.expr(f"substring(rest, {width + 1})")})
        counted = scratch.cut(digits.groupBy("group", "digit").agg(F.min("id").alias("next"), F.count("*").alias("n")).filter("n > 1"))
        after = scratch.cut(digits.join(counted, ["group", "digit"]).select("id", "sha", F.col("next").alias("group"), "n", "rest"))
        scratch.forget(rest)
        ended.append(after.filter(F.octet_length("rest") == 0).select("id", "sha", "group", "n").dropDuplicates(["id", "sha"]))
        rest = scratch.cut(after.filter(F.octet_length("rest") > 0).select("id", "sha", "group", "rest"))
    found = ended[0]
    for more in ended[1:]:
        found = found.unionByName(more)
    real = lambda c: F.when(c != NULL_ID, c)
    out = first.select("id", "sha").join(found, ["id", "sha"], "left").withColumn("keep", F.coalesce("group", "id"))
    return out.select(
        real(F.col("id")).alias("doc_id"),
        real(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("id") == F.col("keep")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
