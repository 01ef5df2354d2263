"""A Python data source over stores of tables: credentials by a ladder with a probe, blocks as partitions, columns and filters that reach the store.

A store is a class with `probe()`, `tables()`, `schema(table)`, `blocks(table)` and `read(table, block, columns, tests)`; it is named by the option
`store` as `module:class` and made from the credentials and the options. FolderStore reads Parquet tables below a folder.
"""

from __future__ import annotations

import json
import logging
import os
from collections.abc import Iterable, Iterator, Sequence
from importlib import import_module

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs  # noqa: F401  as pa.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as DS
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)

#: Filters that a store is asked to apply, by their name in a test (column, name, value).
TESTS = {DS.EqualTo: "=", DS.GreaterThan: ">", DS.GreaterThanOrEqual: ">=", DS.LessThan: "<", DS.LessThanOrEqual: "<=", DS.In: "in", DS.IsNotNull: "not null", DS.StringStartsWith: "starts with"}


# Connecting


def _key_file(options: dict) -> dict | None:
    path = options.get("key_file")
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    return None


def _variable(options: dict) -> dict | None:
    value = os.environ.get(options.get("key_variable", "HOSTLOOM_KEY"))
    return _key_file({"key_file": value}) or {"token": value} if value else None


#: Ways to get credentials, in order; one that has none is passed over.
LADDER = {"key file": _key_file, "environment": _variable, "default": lambda options: {}}


def connect(options: dict) -> tuple[object, str]:
    """A store that has answered a probe, and the way its credentials came. A way whose store fails is logged and the next one is tried; where
    none is left, the error tells what each said."""
    module, name = options.get("store", "hostloom.sources.warehouse:FolderStore").split(":")
    kind, said = getattr(import_module(module), name), []
    for way, get in LADDER.items():
        try:
            credentials = get(options)
            if credentials is None:
                continue
            store = kind(credentials, dict(options))
            store.probe()
            return store, way
        except Exception as e:  # noqa: BLE001  whatever a way fails with, the next one is tried
            log.warning("credentials by %s: %s", way, e)
            said.append(f"{way}: {e}")
    raise ConnectionError("no credentials were taken; " + "; ".join(said))


def test_connection(options: dict) -> bool:
    """Whether any credentials are taken."""
    try:
        connect(options)
    except ConnectionError:
        return False
    return True


def info(options: dict) -> dict:
    """What is known of the store: how it was reached and its tables."""
    store, way = connect(options)
    return {"way": way, "tables": store.tables()}


class FolderStore:
    """Parquet tables below the option `folder`, in any storage that Arrow opens. A file `_token` there, if any, tells the token that is asked for.
    A block is a row group; blocks whose statistics rule a test out aren't listed."""

    def __init__(self, credentials: dict, options: dict):
        folder = options["folder"]
        self.system, self.folder = pa.fs.FileSystem.from_uri("file://" + folder.removeprefix("file:").removeprefix("//") if folder.startswith(("/", "file:")) else folder)
        self.token = credentials.get("token")

    def probe(self) -> None:
        wanted = f"{self.folder}/_token"
        if self.system.get_file_info(wanted).type == pa.fs.FileType.File:
            with self.system.open_input_stream(wanted) as f:
                if f.read().decode().strip() != self.token:
                    raise PermissionError("another token is asked for")

    def tables(self) -> list[str]:
        found = self.system.get_file_info(pa.fs.FileSelector(self.folder))
        return sorted(f.base_name.removesuffix(".parquet") for f in found if f.base_name.endswith(".parquet"))

    def _files(self, table: str) -> list[str]:
        path = f"{self.folder}/{table}.parquet"
        if self.system.get_file_info(path).type != pa.fs.FileType.Directory:
            return [path]
        return sorted(f.path for f in self.system.get_file_info(pa.fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", ".")))

    def schema(self, table: str) -> StructType:
        return from_arrow_schema(pq.read_schema(self._files(table)[0], filesystem=self.system))

    def blocks(self, table: str, tests: list[tuple]) -> list[tuple[str, int]]:
        out = []
        for path in self._files(table):
            with pq.ParquetFile(path, filesystem=self.system) as f:
                out += [(path, k) for k in range(f.num_row_groups) if not _ruled_out(f.metadata.row_group(k), tests)]
        return out

    def read(self, table: str, block: tuple[str, int], columns: list[str], tests: list[tuple]) -> Iterator[pa.RecordBatch]:
        with pq.ParquetFile(block[0], filesystem=self.system) as f:
            held = f.read_row_group(block[1], columns=sorted({*columns, *(t[0] for t in tests)}))
        keep = expression(tests)
        yield from (held if keep is None else held.filter(keep)).select(columns).to_batches(10_000)


def _ruled_out(group, tests: list[tuple]) -> bool:
    """Whether a row group's least and largest values tell that no row passes."""
    named = {group.column(k).path_in_schema: group.column(k).statistics for k in range(group.num_columns)}
    for column, test, value in tests:
        s = named.get(column)
        if s is None or not s.has_min_max or test not in ("=", ">", ">=", "<", "<="):
            continue
        if test in ("=", "<", "<=") and (s.min > value or test == "<" and s.min >= value) or test in ("=", ">", ">=") and (s.max < value or test == ">" and s.max <= value):
            return True
    return False


def expression(tests: list[tuple]) -> pc.Expression | None:
    """The tests as one Arrow expression; null passes none."""
    out = None
    for column, test, value in tests:
        c = pc.field(column)
        one = {"=": lambda c=c, v=value: c == v, ">": lambda c=c, v=value: c > v, ">=": lambda c=c, v=value: c >= v, "<": lambda c=c, v=value: c < v, "<=": lambda c=c, v=value: c <= v, "in": lambda c=c, v=value: c.isin(list(v)), "not null": lambda c=c: c.is_valid(), "starts with": lambda c=c, v=value: pc.starts_with(c, v)}[test]()
        out = one if out is None else out & one
    return out


# The data source


class Block(DS.InputPartition):
    def __init__(self, value, tests):
        super().__init__(value)
        self.tests = tests


class Reader(DS.DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options, self.tests = schema, options, []

    def pushFilters(self, filters: list[DS.Filter]) -> Iterable[DS.Filter]:
        for f in filters:
            kind, value = TESTS.get(type(f)), getattr(f, "value", None)
            plain = isinstance(value, (int, float, str, tuple, list, type(None)))  # times are left to Spark
            if kind and plain and len(f.attribute) == 1:
                self.tests.append((f.attribute[0], kind, value))
            else:
                yield f

    def partitions(self) -> Sequence[DS.InputPartition]:
        store, _ = connect(self.options)
        return [Block(b, self.tests) for b in store.blocks(self.options["table"], self.tests)]

    def read(self, partition: Block | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no block is left
            return
        store, _ = connect(self.options)
        arrow = to_arrow_schema(self.schema)
        for batch in store.read(self.options["table"], partition.value, self.schema.names, partition.tests):
            yield pa.Table.from_batches([batch]).cast(arrow).combine_chunks().to_batches()[0] if len(batch) else batch.slice(0, 0).cast(arrow)


class Warehouse(DS.DataSource):
    """Options: table; columns (names with commas between, all by default); store and what it takes; key_file, key_variable."""

    @classmethod
    def name(cls) -> str:
        return "warehouse"

    def schema(self) -> StructType:
        store, _ = connect(self.options)
        whole = store.schema(self.options["table"])
        wanted = self.options.get("columns")
        return StructType([whole[c] for c in wanted.split(",")]) if wanted else whole

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))


def read(spark: SparkSession, table: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """A table of a store. Spark hands filters down to a Python source, but not the columns it needs, so they are told here; blocks are
    read by as many tasks, and only these columns and the filters' go through the store's reader."""
    spark.dataSource.register(Warehouse)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    wanted = {"columns": ",".join(columns)} if columns else {}
    return spark.read.format("warehouse").options(table=table, **wanted, **options).load()
