"""The whole inventory run: scan rows, discover, resolve, classify, relate, analyse, store; resumable by stage.

Each stage is one lazy plan whose result is written with a manifest; a run that is started again reads the stages
that have ended and goes on with the first one that hasn't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog
from ..operators import classify as C
from ..operators import discovery as D
from ..operators import graph as G
from ..operators import quality as Q
from ..operators import relate as R
from ..operators import resolve as E
from ..sources import sinks as S
from .config import Config
from .observe import Timings

STAGES = ["picked", "hosts", "matches", "classes", "entities", "relationships", "anomalies", "insights", "quality", "components", "statistics"]


class Inventory:
    """raw: rows as hostloom.operators.catalog.inventory_rows or hostloom.sources.inventory.host_raw give them. path: where stages and results go."""

    def __init__(self, spark: SparkSession, raw: DataFrame, path: str, now: str, config: Config | None = None):
        self.spark, self.raw, self.path, self.now = spark, raw, path.rstrip("/"), now
        self.config, self.timings, self.resumed = config or Config(), Timings(), []

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, path: str, now: str, config: Config | None = None, include: str = ".*", exclude: str | None = None) -> Inventory:
        """A run over what all tables of a folder tell of hosts, whatever their columns are called."""
        rows = catalog.host_rows(catalog.tables(spark, folder, include, exclude))
        return cls(spark, catalog.inventory_rows(rows), path, now, config)

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        found = S.load_stage(self.spark, self.path, name)
        if found is not None:
            self.resumed.append(name)
            return found
        with self.timings.step(name):
            return S.save_stage(make(), self.path, name)

    def run(self) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}

        def step(name: str, make: Callable[[], DataFrame]) -> DataFrame:
            out[name] = self.stage(name, make)
            return out[name]

        picked = step("picked", lambda: D.picked(self.raw))
        hosts = step("hosts", lambda: D.enrich(D.group_hosts(picked)))
        pairs = E.candidate_pairs(E.blocking_keys(hosts))
        step("matches", lambda: E.masters(E.match(E.similarity(pairs, hosts, picked), self.config.get("resolution.threshold"))))
        classes = step("classes", lambda: C.classify(hosts, picked))
        entities = step("entities", lambda: hosts.join(classes.select("hostname", "type", "sub_type", "method"), "hostname").join(C.criticality(hosts, classes).select("hostname", "criticality"), "hostname").join(C.tags(hosts, classes), "hostname"))
        edges = step("relationships", lambda: R.all_relationships(hosts, picked))
        linked = edges.select("source", "target").unionByName(R.member_edges(entities, edges))
        step("anomalies", lambda: Q.anomalies(entities, linked))
        step("insights", lambda: Q.insights(entities, edges))
        step("quality", lambda: Q.dimensions(entities, edges, self.now))
        step("components", lambda: G.components(entities.select(F.col("hostname").alias("id")), linked))
        step("statistics", lambda: S.statistics_rows(Q.statistics(entities, edges)))
        return out

    def export(self, out: dict[str, DataFrame]) -> None:
        for form in self.config.get("output.formats"):
            for name in ("entities", "relationships", "anomalies"):
                S.export(out[name], f"{self.path}/export/{name}.{form}", form)

    def summary(self, out: dict[str, DataFrame], top: int = 5) -> str:
        lines = [f"{r.key}: {r.value}" for r in out["statistics"].orderBy("key").collect()]
        return "\n".join([*lines, *(f"- {r.insight}" for r in out["insights"].limit(top).collect())])


def sql(spark: SparkSession, tables: dict[str, DataFrame], text: str) -> DataFrame:
    """Ad-hoc SQL over the tables of a run; an error in the text is raised."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(text)
