"""Queries on file inventories and on scans of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.shape import relaxed_union, with_provenance
from millrace.plans.catalog.registry import query, table
from millrace.plans.inputs import file_source
from millrace.scratch import Scratch
from millrace.sources.files import (
    group_by_day,
    group_by_name,
    group_by_parent,
    group_single,
    group_summary,
    inventory,
    select_all,
    select_latest,
    select_latest_per_source,
    select_named,
    skip_known,
    with_patterns,
)
from millrace.sources.scan import query as sql_query
from millrace.sources.scan import scan, with_file_hash
from millrace.sources.tables import TableStore

# The SQL below can name only one folder: that of the scale the results are compared at.
FILES_SQL = """
WITH files AS (
  SELECT parse_filename(filename) AS file_name, size AS size_bytes, sha256(content) AS content_hash
  FROM read_blob('/root/testdata/sf0.01/*.parquet'))
"""


@query(
    "file_inventory",
    FILES_SQL
    + "SELECT file_name, file_name AS relative_path, '.parquet' AS suffix, size_bytes, content_hash FROM files",
)
def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = select_all(inventory(spark, sf_dir, source_id="warehouse"))
    return files.select("file_name", "relative_path", "suffix", "size_bytes", "content_hash")


# Events as files of an inventory: one folder per kind, one file per event.
EVENT_FILES_SQL = """
WITH files AS (
  SELECT event_type AS source_id, event_type || '/' || user_id || '-' || event_id || '.json' AS relative_path,
    user_id || '-' || event_id || '.json' AS file_name, CAST(round(value * 100) AS BIGINT) AS size_bytes,
    ts AS modified_at
  FROM events)
"""


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws("-", "user_id", F.concat("event_id", F.lit(".json")))
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("source_id"),
        F.concat_ws("/", F.lit("/data"), "event_type", name).alias("path"),
        F.concat_ws("/", "event_type", name).alias("relative_path"),
        name.alias("file_name"),
        F.round(F.col("value") * 100).cast("long").alias("size_bytes"),
        F.col("ts").alias("modified_at"),
    )


@query(
    "file_patterns",
    EVENT_FILES_SQL
    + """
SELECT relative_path FROM files
WHERE (relative_path LIKE 'click/%' OR file_name SIMILAR TO '1.-.*7[.]json') AND NOT file_name LIKE '%3.json'
""",
)
def file_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = with_patterns(
        event_files(spark, sf_dir), include=["click/*", "1?-*7.json"], exclude=["*3.json"]
    )
    return files.select("relative_path")


@query(
    "file_latest",
    EVENT_FILES_SQL + "SELECT relative_path FROM files ORDER BY modified_at DESC, relative_path DESC LIMIT 1",
)
def file_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_latest(event_files(spark, sf_dir)).select("relative_path")


@query(
    "file_latest_per_source",
    EVENT_FILES_SQL
    + """
SELECT relative_path FROM files
QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY modified_at DESC, relative_path DESC) <= 2
""",
)
def file_latest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_latest_per_source(event_files(spark, sf_dir), 2).select("relative_path")


@query(
    "file_unchanged_skip",
    FILES_SQL + "SELECT file_name FROM files WHERE file_name NOT IN ('orders.parquet', 'lineitem.parquet')",
)
def file_unchanged_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files left to load when two of them were loaded before."""
    files = inventory(spark, sf_dir)
    loaded = select_named(files, r"^(orders|lineitem)\.")
    return skip_known(files, loaded).select("file_name")


@query(
    "file_groups",
    EVENT_FILES_SQL
    + """, grouped AS (
  SELECT source_id || '__single_group' AS group_id, size_bytes FROM files
  UNION ALL SELECT source_id || '__' || split_part(file_name, '-', 1), size_bytes FROM files
  UNION ALL SELECT source_id || '__' || split_part(relative_path, '/', 1), size_bytes FROM files
  UNION ALL SELECT source_id || '__' || CAST(CAST(modified_at AS DATE) AS VARCHAR), size_bytes FROM files)
SELECT group_id, count(*) AS asset_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes
FROM grouped GROUP BY group_id
""",
)
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = event_files(spark, sf_dir)
    grouped = [
        group_single(files),
        group_by_name(files, "^([0-9]+)-"),
        group_by_parent(files),
        group_by_day(files),
    ]
    return group_summary(relaxed_union(grouped))


@query(
    "file_provenance",
    """
SELECT c_custkey AS id, 'customer.parquet' AS file_name,
  (SELECT sha256(content) FROM read_blob('/root/testdata/sf0.01/customer.parquet')) AS _file_hash FROM customer
UNION ALL
SELECT s_suppkey, 'supplier.parquet',
  (SELECT sha256(content) FROM read_blob('/root/testdata/sf0.01/supplier.parquet')) FROM supplier
UNION ALL SELECT r_regionkey, 'unknown', 'unknown' FROM region
""",
)
def file_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = inventory(spark, sf_dir)
    customers = scan(spark, f"{sf_dir}/customer.parquet").withColumnRenamed("c_custkey", "id")
    suppliers = scan(spark, f"{sf_dir}/supplier.parquet").withColumnRenamed("s_suppkey", "id")
    read = relaxed_union(
        [customers.select("id", "_source_file"), suppliers.select("id", "_source_file")]
    )
    stamped = with_file_hash(read, files, scratch=Scratch(spark))
    regions = with_provenance(
        table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"))
    )
    both = relaxed_union([stamped, regions])
    return both.select(
        "id", F.substring_index("_source_file", "/", -1).alias("file_name"), "_file_hash"
    )


@query(
    "query_scan",
    """
SELECT n.n_name, count(*) AS customers, max(c.c_acctbal) AS best
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE c.c_acctbal > 0 GROUP BY n.n_name
""",
)
def query_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql_query(
        spark,
        """
        SELECT n.n_name, count(*) AS customers, max(c.c_acctbal) AS best
        FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
        WHERE c.c_acctbal > 0 GROUP BY n.n_name
        """,
        {"customer": table(spark, sf_dir, "customer"), "nation": table(spark, sf_dir, "nation")},
    )


@query(
    "file_format_scan",
    """
SELECT f.format, CAST(c_custkey AS BIGINT) AS c_custkey, c_name, c_acctbal
FROM customer, (VALUES ('csv'), ('json'), ('orc'), ('parquet')) f(format)
""",
)
def file_format_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written in each format and read back as one frame."""
    scratch = Scratch(spark)
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    schema = customers.schema
    frames = []
    for name in ("csv", "json", "orc", "parquet"):
        path = scratch.path(name)
        writer = customers.write.format(name)
        if name == "csv":
            writer = writer.option("header", "true").option("delimiter", ";")
        writer.save(path)
        delimiter = ";" if name == "csv" else None
        read = scan(spark, path, name, schema=schema, delimiter=delimiter)
        frames.append(read.drop("_source_file").withColumn("format", F.lit(name)))
    return relaxed_union(frames)


@query(
    "stored_table_scan",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def stored_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan of a stored table; the status is a partition, so other files are not opened."""
    store = TableStore(spark, Scratch(spark).path("store"))
    store.append_rows("orders", table(spark, sf_dir, "orders"), "o_orderstatus")
    found = store.read("orders").filter(F.col("o_orderstatus") == "F")
    return found.select("o_orderkey", "o_totalprice")


@query(
    "file_schema_drift",
    """
SELECT 'parquet' AS format, CASE WHEN o_orderstatus = 'P' THEN 'K' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS key,
       CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS price, o_orderpriority AS priority
FROM orders
UNION ALL
SELECT 'csv', CASE WHEN o_orderstatus = 'P' THEN 'K' ELSE '' END || CAST(o_orderkey AS VARCHAR),
       CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END, o_orderpriority FROM orders
""",
)
def file_schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a source that lack a column, have them in another order, or of another type."""
    scratch = Scratch(spark)
    orders = table(spark, sf_dir, "orders")
    key, price = F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")
    priority = F.col("o_orderpriority").alias("priority")
    layouts = {
        "F": [key, price, priority],
        "O": [priority, key],
        "P": [price, F.concat(F.lit("K"), F.col("o_orderkey").cast("string")).alias("key"), priority],
    }
    frames = []
    for name in ("parquet", "csv"):
        root = scratch.path(name)
        for status, columns in layouts.items():
            rows = orders.filter(F.col("o_orderstatus") == status).select(*columns)
            rows.write.option("header", "true").format(name).save(f"{root}/{status}")
        source = file_source("orders", root, name, recursive=True, include=[f"*.{name}"])
        (read,) = source.read(spark)
        frames.append(
            read.select(F.lit(name).alias("format"), "key", F.col("price").cast("double"), "priority")
        )
    return frames[0].unionByName(frames[1])
