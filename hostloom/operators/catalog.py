"""Discovery over a whole catalog: from tables of any schema to rows of hosts, with no column named in advance.

The columns of every table are judged by their names and by what is in them; a plan for each table says which columns give
host names and addresses, in the order of their confidence, and the tables' rows, whatever their schemas, come out in one form.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import host as H
from .discovery import ATTRIBUTES, column_confidence, picked_name

#: A host name or address column's least confidence; from which likelihoods on values count; and what a column of many distinct values gains, from which share on.
LEAST, HOST_LIKELY, IP_LIKELY, GAIN, DISTINCT = 0.5, 0.6, 0.7, 0.1, 0.9
CATEGORIES = ("hostname", "ip", "environment", "application")
#: What a column's name may tell of besides.
OTHERS = ("environment", "application", "owner", "location", "cluster", "project")


@dataclass
class Plan:
    """Columns of a table by category, the most confident first."""

    hostname: list[tuple[str, float]] = field(default_factory=list)
    ip: list[tuple[str, float]] = field(default_factory=list)
    environment: list[tuple[str, float]] = field(default_factory=list)
    application: list[tuple[str, float]] = field(default_factory=list)


def tables(spark: SparkSession, folder: str, include: str = ".*", exclude: str | None = None) -> dict[str, DataFrame]:
    """The Parquet tables of a folder by name; include and exclude are patterns of whole names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(f.getPath().getName().removesuffix(".parquet") for f in listed if f.getPath().getName().endswith(".parquet"))
    names = [n for n in names if re.fullmatch(include, n) and not (exclude and re.fullmatch(exclude, n))]
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def _column(name: str) -> Column:
    return F.col(f"`{name}`")


def likely_hostname(c: Column) -> Column:
    """A valid host name that can be told from a word or a number: it begins with a letter and has a hyphen or a dot."""
    return H.valid_hostname(c) & F.coalesce(c.rlike(r"^[A-Za-z].*[-.]"), F.lit(False))


def profile(sources: dict[str, DataFrame]) -> DataFrame:
    """A row for each column: table_name, column_name, ordinal, filled (values that aren't null or empty), hosts and addresses among
    them. One scan and one aggregation a table; columns that aren't text have neither by definition."""
    out = None
    for table, df in sources.items():
        sums = []
        for f in df.schema:
            c = _column(f.name)
            text = isinstance(f.dataType, (T.StringType, T.VarcharType, T.CharType))
            sums += [F.count_if(c != "") if text else F.count(c), F.count_if(likely_hostname(c)) if text else F.lit(0).cast("long"), F.count_if(H.valid_ip(c)) if text else F.lit(0).cast("long")]
        one = df.agg(F.array(*sums).alias("x"))
        each = F.explode(F.array(*(F.struct(F.lit(f.name).alias("column_name"), F.lit(k).alias("ordinal"), F.col("x")[3 * k].alias("filled"), F.col("x")[3 * k + 1].alias("hosts"), F.col("x")[3 * k + 2].alias("addresses")) for k, f in enumerate(df.schema)))).alias("c")
        rows = one.select(F.lit(table).alias("table_name"), each).select("table_name", "c.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def judged(profiled: DataFrame) -> DataFrame:
    """profile() with a confidence for each category, null where nothing speaks for it. Values that look like host names count only in
    columns whose names tell of nothing else: owners and regions look alike. What distinct values add is left to found()."""
    share = lambda c: F.when(F.col("filled") > 0, F.col(c) / F.col("filled"))
    name = F.col("column_name")
    other = F.greatest(*(column_confidence(name, c) for c in OTHERS))
    by_values = {"hostname": F.when(other.isNull() & (share("hosts") > HOST_LIKELY), share("hosts")), "ip": F.when(share("addresses") > IP_LIKELY, share("addresses"))}
    return profiled.withColumns({c: F.greatest(column_confidence(name, c), by_values.get(c, F.lit(None).cast("double"))) for c in CATEGORIES})


def found(sources: dict[str, DataFrame]) -> DataFrame:
    """Rows table_name, column_name, ordinal, category, confidence: the columns that discovery uses. Distinct values are counted only
    where they can decide, in columns that may give host names."""
    rows = judged(profile(sources)).collect()  # a row a column
    spark = next(iter(sources.values())).sparkSession
    counted = []
    for r in rows:
        if r.hostname is not None and r.hostname > LEAST - GAIN:
            c = F.nullif(_column(r.column_name).cast("string"), F.lit(""))
            counted.append(sources[r.table_name].agg(F.lit(r.table_name).alias("t"), F.lit(r.column_name).alias("c"), F.coalesce(F.count_distinct(c) / F.nullif(F.count(c), F.lit(0)), F.lit(0.0)).alias("d")))
    distinct = {(r.t, r.c): r.d for r in reduce(DataFrame.unionAll, counted).collect()} if counted else {}
    out = []
    for r in rows:
        for category in CATEGORIES:
            confidence = r[category]
            if confidence is not None and category == "hostname" and distinct.get((r.table_name, r.column_name), 0) > DISTINCT:
                confidence += GAIN
            if confidence is not None and (confidence > LEAST or category in ("environment", "application")):
                out.append((r.table_name, r.column_name, r.ordinal, category, confidence))
    return spark.createDataFrame(out, "table_name string, column_name string, ordinal int, category string, confidence double")


def plans(columns: DataFrame) -> dict[str, Plan]:
    """By table, what found() tells."""
    out: dict[str, Plan] = {}
    for r in sorted(columns.collect(), key=lambda r: (r.table_name, -r.confidence if r.category in ("hostname", "ip") else 0, r.ordinal)):
        getattr(out.setdefault(r.table_name, Plan()), r.category).append((r.column_name, r.confidence))
    return out


def _attributes(df: DataFrame, plan: Plan) -> Column:
    """All that a row tells of its host: valid addresses, environments and applications in lower case, and every other column under its own name."""
    told = [c for c, _ in plan.hostname + plan.ip + plan.environment + plan.application]
    text = {f.name: F.to_json(_column(f.name)) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else _column(f.name).cast("string") for f in df.schema}
    pairs = [("ip_address", F.when(H.valid_ip(text[c]), text[c])) for c, _ in plan.ip]
    pairs += [(name, F.lower(F.nullif(text[c], F.lit("")))) for name in ("environment", "application") for c, _ in getattr(plan, name)]
    pairs += [(c, v) for c, v in text.items() if c not in told]
    every = F.array(*(F.struct(F.lit(n).alias("attribute"), v.alias("value")) for n, v in pairs))
    return F.filter(every, lambda x: x["value"].isNotNull())


def host_rows(sources: dict[str, DataFrame], columns: DataFrame | None = None) -> DataFrame:
    """Rows table_name, hostname, confidence, attributes (an array of attribute, value) of all tables that have a host name or an address
    column; rows without a valid one are left out. Each table is read once, with only its plan's expressions."""
    columns, out = found(sources) if columns is None else columns, None
    for table, plan in plans(columns).items():
        if not plan.hostname and not plan.ip:
            continue
        df = sources[table]
        names, ips = ([(_column(c).cast("string"), conf) for c, conf in cs] for cs in (plan.hostname, plan.ip))
        name, confidence = picked_name(names, ips)
        rows = df.select(F.lit(table).alias("table_name"), name.alias("hostname"), confidence.alias("confidence"), _attributes(df, plan).alias("attributes")).filter("hostname is not null")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        spark = next(iter(sources.values())).sparkSession
        return spark.createDataFrame([], "table_name string, hostname string, confidence double, attributes array<struct<attribute: string, value: string>>")
    return out


def long(rows: DataFrame) -> DataFrame:
    """host_rows() as one row for each value: table_name, hostname, confidence, attribute, value."""
    return rows.select("table_name", "hostname", "confidence", F.explode("attributes").alias("x")).select("table_name", "hostname", "confidence", "x.attribute", "x.value")


def hosts(rows: DataFrame) -> DataFrame:
    """One row a host: how many rows and tables tell of it, and the highest confidence."""
    return rows.groupBy("hostname").agg(F.count("*").alias("n_sources"), F.count_distinct("table_name").alias("n_tables"), F.max("confidence").alias("confidence"))


def inventory_rows(rows: DataFrame) -> DataFrame:
    """host_rows() in the form that the inventory run starts from: table_name, row_id, host_name, ip_address, environment, application and
    the known attributes, each the first value that the row has for it; row_id numbers the rows."""
    value = lambda name: F.get(F.filter("attributes", lambda x: x["attribute"] == name), F.lit(0))["value"]
    kinds = {"cpu_cores": "int", "memory_gb": "int"}
    own = [value(a).try_cast(kinds.get(a, "string")).alias(a) for a in ("ip_address", "environment", "application", *ATTRIBUTES)]
    return rows.select("table_name", F.monotonically_increasing_id().alias("row_id"), F.col("hostname").alias("host_name"), *own)
