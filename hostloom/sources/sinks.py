"""Stores, exports, messages and stage checkpoints."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOPICS = {"discoveries": "hostname", "classifications": "column_name", "relationships": None}


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of new, and those of old whose key new doesn't have; the last row of new for a key, by version."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("version")))
    return old.unionByName(new).withColumn("rn", rank).filter("rn = 1").drop("rn")


def attribute_rows(attributes: DataFrame, most: int = 10) -> DataFrame:
    """hostname, attribute, value as JSON: one value as it is, more as a list cut to most."""
    rank = F.row_number().over(Window.partitionBy("hostname", "attribute").orderBy("value"))
    few = attributes.select("hostname", "attribute", "value").distinct().withColumn("rn", rank).filter(F.col("rn") <= most)
    each = few.groupBy("hostname", "attribute").agg(F.array_sort(F.collect_list("value")).alias("v"))
    return each.select("hostname", "attribute", F.when(F.size("v") == 1, F.to_json(F.create_map(F.lit("value"), F.col("v")[0]))).otherwise(F.to_json("v")).alias("value"))


def statistics_rows(one: DataFrame) -> DataFrame:
    """key, value of a one-row table."""
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, one.columns)), F.array(*(F.col(c).cast("string") for c in one.columns))))).toDF("key", "value")


def store(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as Parquet below path, replacing what was there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a store; where a table has is_active, its active rows."""
    found = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    return {n: df.filter("is_active") if "is_active" in df.columns else df for n, df in found.items()}


def export(df: DataFrame, path: str, form: str = "parquet") -> None:
    """parquet, csv (with a header; nested columns as JSON) or json."""
    if form == "csv":
        from ..operators.scan import complex_as_json

        complex_as_json(df).write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").format(form).save(path)


def messages(df: DataFrame, topic: str, now: str) -> DataFrame:
    """topic, key, value: a JSON message a row, with a time stamp; the key is the topic's."""
    key = TOPICS.get(topic)
    value = F.to_json(F.struct("*", F.lit(now).alias("timestamp")))
    return df.select(F.lit(topic).alias("topic"), (F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"), value.alias("value"))


def publish(df: DataFrame, path: str | None = None, servers: str | None = None) -> None:
    """Messages to a broker if servers are given (its connector must be on the class path), else as JSON files."""
    if servers:
        df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.compression.type", "gzip").option("kafka.linger.ms", 10).option("kafka.batch.size", 16384).save()
    else:
        df.write.mode("append").json(path)


def save_stage(df: DataFrame, path: str, stage: str) -> DataFrame:
    """A stage of the pipeline as Parquet with a manifest row; the manifest is written last."""
    df.write.mode("overwrite").parquet(f"{path}/{stage}/data")
    out = df.sparkSession.read.parquet(f"{path}/{stage}/data")
    manifest = json.dumps({"stage": stage, "rows": out.count(), "columns": out.columns})
    df.sparkSession.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{stage}/manifest")
    return out


def load_stage(spark: SparkSession, path: str, stage: str) -> DataFrame | None:
    """A finished stage, or None where its manifest is missing."""
    try:
        held = spark.read.text(f"{path}/{stage}/manifest")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":  # the stage hasn't ended
            return None
        raise
    manifest = json.loads(held.first()[0])
    return spark.read.parquet(f"{path}/{stage}/data").select(manifest["columns"])
