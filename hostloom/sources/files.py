"""File and message sources beside Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_warehouse(spark: SparkSession, form: str, **options: str) -> DataFrame:
    """A table of any connector that Spark can load, such as jdbc or a Python data source registered on the session."""
    return spark.read.format(form).options(**options).load()


def subscribe(spark: SparkSession, topics: list[str], servers: str | None = None, path: str | None = None) -> DataFrame:
    """A stream of messages topic, key, value: from a broker if servers are given, else from JSON files below path."""
    if servers:
        raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "latest").load()
        return raw.selectExpr("topic", "CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value")
    stream = spark.readStream.schema("topic string, key string, value string").json(path)
    return stream.filter(stream.topic.isin(topics))
