"""Stored tables in buckets, sorted within: the layout that stands for indexes. Tables of one key join without an exchange, a lookup by key
reads one bucket, and an upsert rewrites only the buckets that its rows fall into.

A table is a Spark table with a path of its own. An upsert writes the new buckets beside the table, notes what it is about to exchange in a journal, and
then exchanges the files; an upsert that was cut off is ended by the next use of the table.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import upsert as merged

_BUCKET = re.compile(r"_(\d{5})(?:\.c\d+)?\.[a-z.]*parquet$")


@dataclass
class Buckets:
    """A table: its name in the catalog, the folder, the keys and how many buckets there are."""

    spark: SparkSession
    name: str
    path: str
    keys: list[str]
    n: int

    def _hadoop(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def write(self, df: DataFrame) -> Buckets:
        """Makes the table of df's rows, in place of what was there."""
        system, p = self._hadoop(self.path)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        system.delete(p, True)
        self._saved(df, self.name, self.path)
        return self

    def _saved(self, df: DataFrame, name: str, path: str) -> None:
        # a task a bucket, so a bucket is one file
        df.repartition(self.n, *self.keys).write.format("parquet").bucketBy(self.n, *self.keys).sortBy(*self.keys).option("path", path).saveAsTable(name)

    def read(self) -> DataFrame:
        self.recover()
        return self.spark.table(self.name)

    def files(self) -> dict[int, list[str]]:
        """The files of each bucket that has rows."""
        system, p = self._hadoop(self.path)
        out: dict[int, list[str]] = {}
        for f in system.listStatus(p):
            if found := _BUCKET.search(f.getPath().getName()):
                out.setdefault(int(found[1]), []).append(f.getPath().toString())
        return out

    def bucket(self):
        """The bucket of a row, as Spark tells it when it writes."""
        return F.pmod(F.hash(*self.keys), F.lit(self.n))

    def upsert(self, new: DataFrame, exchange: bool = True) -> set[int]:
        """Rows of new in place of those of their keys, the last by `version` of several; gives the buckets that were rewritten. The files of the others stay as
        they are. new is read twice."""
        self.recover()
        touched = {r[0] for r in new.select(self.bucket().alias("b")).distinct().collect()}  # n at most
        if not touched:
            return touched
        held = self.files()
        old = [f for b in touched for f in held.get(b, [])]
        schema = self.spark.table(self.name).schema
        rows = self.spark.read.schema(schema).parquet(*old) if old else self.spark.createDataFrame([], schema)
        temporary, beside = f"{self.name}_{uuid.uuid4().hex}", f"{self.path}-{uuid.uuid4().hex}"
        self._saved(merged(rows, new.select(*schema.names), self.keys), temporary, beside)
        made = Buckets(self.spark, temporary, beside, self.keys, self.n).files()
        self.spark.sql(f"DROP TABLE {temporary}")  # the files stay, for the table has a path of its own
        self._note({"old": old, "new": [f for fs in made.values() for f in fs], "beside": beside})
        if exchange:
            self.recover()
        return touched

    def _journal(self) -> str:
        return f"{self.path}/_exchange.json"

    def _note(self, entry: dict) -> None:
        """Writes the journal under another name first: it is there whole or not at all."""
        system, p = self._hadoop(self._journal() + ".new")
        out = system.create(p, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        system.rename(p, self._hadoop(self._journal())[1])

    def recover(self) -> None:
        """Ends the exchange that the journal tells of, if any: each step may be done again."""
        system, journal = self._hadoop(self._journal())
        if not system.exists(journal):
            return
        source = system.open(journal)
        entry = json.loads(bytes(source.readAllBytes()))
        source.close()
        for path in entry["new"]:
            p = self._hadoop(path)[1]
            if system.exists(p):
                system.rename(p, self._hadoop(f"{self.path}/{p.getName()}")[1])
        for path in entry["old"]:
            system.delete(self._hadoop(path)[1], False)
        system.delete(journal, False)
        system.delete(self._hadoop(entry["beside"])[1], True)
        self.spark.catalog.refreshTable(self.name)


def buckets(spark: SparkSession, name: str, path: str, keys: list[str], n: int = 64) -> Buckets:
    """A handle of a table; write() makes it. n: choose it so that a bucket of the full table fits in a task."""
    return Buckets(spark, name, path.rstrip("/"), keys, n)


def without_exchange(df: DataFrame) -> bool:
    """Whether a plan has no exchange of rows."""
    return "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
