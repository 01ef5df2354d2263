"""Inventory hidden in ordinary tables: the rows that discovery starts from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("customer", "supplier", "pages", "nation")
#: Rows that a task of discovery should have.
ROWS = 1 << 15

#: All rows of four tables (one of them told by two sources) with host names, addresses and attributes; runs on Spark and DuckDB alike. Three customers make a
#: host, twelve hosts a rack, fifty a network, so groups keep their sizes while the tables grow; half of the hosts are "srv".
HOST_RAW = """
SELECT 'tpch.customer' AS table_name, c_custkey AS row_id,
  concat(role, '-', env, '-', translate(CAST(rack AS STRING), '0123456789', 'abcdefghij'), '-', CAST(k % 12 * CASE WHEN rack % 5 = 1 THEN 20 ELSE 1 END + 1 AS STRING),
         CASE WHEN rack % 3 = 1 THEN '.corp.example.com' ELSE '' END) AS host_name,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('10.', CAST(net * 37 % 200 AS STRING), '.',
         CAST(CAST((net - net % 200) / 200 AS BIGINT) % 250 AS STRING), '.', CAST(c_custkey % 150 + 1 AS STRING)) END AS ip_address,
  CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'unknown'
       ELSE CASE env WHEN 'prod' THEN 'production' WHEN 'stg' THEN 'staging' WHEN 'dev' THEN 'development' ELSE 'testing' END END AS environment,
  CASE role WHEN 'web' THEN 'web' WHEN 'db' THEN 'database' WHEN 'api' THEN 'api' WHEN 'cache' THEN 'cache'
       WHEN 'queue' THEN 'queue' WHEN 'lb' THEN 'load_balancer' ELSE NULL END AS application,
  CASE WHEN k % 4 = 3 THEN NULL ELSE concat('team-', CAST(CAST((k - k % 20) / 20 AS BIGINT) AS STRING)) END AS owner,
  CASE c_custkey % 5 WHEN 0 THEN 'linux' WHEN 1 THEN 'windows' WHEN 2 THEN 'linux' ELSE NULL END AS os_type,
  CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 300 = 6 THEN 256 ELSE CAST(2 + c_custkey * 13 % 31 AS INT) END AS cpu_cores,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(4 + c_custkey * 17 % 97 AS INT) END AS memory_gb,
  CASE c_custkey % 6 WHEN 0 THEN '2024-01-30T12:00:00' WHEN 1 THEN '2024-01-26T00:00:00' WHEN 2 THEN '2024-01-10T00:00:00'
       WHEN 3 THEN '2023-12-01T00:00:00' WHEN 4 THEN '2023-01-01T00:00:00' ELSE NULL END AS last_seen,
  CASE c_custkey % 10 WHEN 0 THEN 'inactive' WHEN 1 THEN NULL ELSE 'active' END AS status
FROM (SELECT *, CASE CAST((k - k % 4) / 4 AS BIGINT) % 12 WHEN 0 THEN 'web' WHEN 1 THEN 'db' WHEN 2 THEN 'api' WHEN 3 THEN 'cache' WHEN 4 THEN 'queue'
        WHEN 5 THEN 'lb' ELSE 'srv' END AS role, CASE rack % 4 WHEN 0 THEN 'prod' WHEN 1 THEN 'stg' WHEN 2 THEN 'dev' ELSE 'qa' END AS env
      FROM (SELECT *, CAST((k - k % 12) / 12 AS BIGINT) AS rack, CAST((k - k % 50) / 50 AS BIGINT) AS net
            FROM (SELECT c_custkey, CAST((c_custkey - c_custkey % 3) / 3 AS BIGINT) AS k FROM customer
            ) x) y) z
UNION ALL
SELECT 'tpch.supplier', s_suppkey,
  concat(CASE s_suppkey % 4 WHEN 0 THEN 'Web' WHEN 1 THEN 'DB' WHEN 2 THEN 'api' ELSE 'sw' END, '-PROD-',
         translate(CAST(CAST((s_suppkey - s_suppkey % 15) / 15 AS BIGINT) AS STRING), '0123456789', 'klmnopqrst'), '-', CAST(s_suppkey % 15 AS STRING),
         CASE s_suppkey % 5 WHEN 0 THEN '.dc.example.com' ELSE '' END),
  concat('192.168.', CAST(s_nationkey AS STRING), '.', CAST(s_suppkey % 300 AS STRING)),
  'production', NULL, 'team-net', 'linux', 8, 32, '2024-01-30T12:00:00Z', 'active'
FROM supplier
UNION ALL
SELECT 'dns.supplier', s_suppkey,
  concat(CASE s_suppkey % 4 WHEN 0 THEN 'Web' WHEN 1 THEN 'DB' WHEN 2 THEN 'api' ELSE 'sw' END, '-PROD-',
         translate(CAST(CAST((s_suppkey - s_suppkey % 15) / 15 AS BIGINT) AS STRING), '0123456789', 'klmnopqrst'), '-', CAST(s_suppkey % 15 AS STRING),
         CASE s_suppkey % 5 WHEN 0 THEN '.dc.example.net' ELSE '' END),
  concat('192.168.', CAST(s_nationkey AS STRING), '.', CAST(s_suppkey % 300 AS STRING)),
  'production', NULL, 'team-net', 'linux', 8, 32, '2024-01-30T12:00:00Z', 'active'
FROM supplier
UNION ALL
SELECT 'web.pages', page_id, regexp_extract(url, '^https?://([^/?#]+)', 1), NULL, NULL, 'web', NULL, NULL,
  CAST(NULL AS INT), CAST(NULL AS INT), NULL, NULL
FROM pages
UNION ALL
SELECT 'tpch.nation', CAST(n_nationkey AS BIGINT),
  CASE n_nationkey WHEN 0 THEN 'srv' WHEN 1 THEN 'web-prod' WHEN 2 THEN 'db-stg' WHEN 3 THEN 'api-dev' WHEN 4 THEN 'lb'
       WHEN 5 THEN 'vm-qa.corp.example.com' WHEN 6 THEN 'test-web-1' WHEN 7 THEN 'demo-db-2' ELSE concat('srv-backup-', CAST(n_nationkey AS STRING)) END,
  concat('172.16.0.', CAST(n_nationkey AS STRING)), 'production', 'backup', 'team-core', 'linux', 16, 64, 'not-a-date', 'active'
FROM nation
"""


#: Tables of other owners: other names for the same things, some that tell nothing, and more columns beside. They grow with the given tables.
DERIVED = {
    "host_raw": HOST_RAW,
    "assets": """
SELECT s_suppkey AS asset_id, concat('asset-', CAST(s_suppkey % 97 AS STRING), '-', CAST(s_nationkey AS STRING)) AS server_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE concat('10.9.', CAST(s_nationkey AS STRING), '.', CAST(s_suppkey % 256 AS STRING)) END AS private_ip,
  CASE s_suppkey % 3 WHEN 0 THEN 'PROD' WHEN 1 THEN 'dev' ELSE '' END AS stage, 'billing' AS service_name, s_acctbal AS cost
FROM supplier
""",
    "dns_records": """
SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS fqdn, 3600 AS ttl, CASE WHEN page_id % 3 = 0 THEN NULL ELSE concat('172.20.', CAST(page_id % 7 AS STRING), '.', CAST(page_id % 200 AS STRING)) END AS ipv4
FROM pages
""",
    "flows": """
SELECT event_id, concat('node-', CAST(user_id % 200 AS STRING), '.flows.example.net') AS seen_at, CASE WHEN event_id % 10 = 0 THEN 'n/a' ELSE concat('192.0.2.', CAST(user_id % 250 AS STRING)) END AS peer, event_type AS kind
FROM events
""",
    "contacts": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'not known' ELSE concat('10.77.0.', CAST(c_custkey % 250 AS STRING)) END AS ip_addr, c_mktsegment AS app
FROM customer
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables of DERIVED."""
    out = {}
    for name, text in DERIVED.items():
        used = [t for t in (*TABLES, "events") if f"FROM {t}\n" in text]
        for t in used:
            text = text.replace(f"FROM {t}\n", f"FROM {{{t}}}\n")
        out[name] = spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})
    return out


def host_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """table_name, row_id, host_name, ip_address, environment, application, owner, os_type, cpu_cores, memory_gb, last_seen, status.

    A table may be one file that one task must read; what follows makes many wide rows of each and sorts them. So rows are dealt over as many tasks as they need."""
    text = HOST_RAW
    for name in TABLES:
        text = text.replace(f"FROM {name}\n", f"FROM {{{name}}}\n")
    tables = {name: table(spark, sf_dir, name) for name in TABLES}
    raw = spark.sql(text, **tables)
    n = reduce(DataFrame.unionAll, (t.select(F.lit(1)) for t in tables.values())).count()  # of footers
    return raw.repartition(-(-n // ROWS)) if n > ROWS else raw
