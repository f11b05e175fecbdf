"""Queries on lineage, run records and totals, over rows made from the event and line tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.audit import (
    file_events,
    get_run,
    lineage_of,
    recent_runs,
    run_records,
    run_totals,
    younger_than,
)
from millrace.plans.catalog.loads import new_store, raw_clients, run_clients
from millrace.plans.catalog.registry import query, table
from millrace.sources.scan import scan


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the life of one run per user and hour: errors fail it, purchases complete it."""
    events = table(spark, sf_dir, "events")
    ended = F.col("event_type").isin("purchase", "error")
    status = F.when(F.col("event_type") == "error", "failed").when(
        F.col("event_type") == "purchase", "completed"
    )
    return events.select(
        "event_id",
        F.concat_ws("@", "user_id", F.date_format("ts", "yyyy-MM-dd HH")).alias("run_id"),
        F.lit("shop").alias("project_id"),
        F.coalesce(status, F.lit("started")).alias("status"),
        F.col("ts").alias("at"),
        F.when(ended, F.col("event_id")).alias("source_count"),
        F.when(ended, F.lit(2)).alias("table_count"),
        F.when(ended, F.floor("value")).alias("total_rows_loaded"),
        F.when(ended, F.lit(0)).alias("total_rows_invalid"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("error_message"),
    )


RUNS_SQL = """
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) || '@' || strftime(ts, '%Y-%m-%d %H') AS run_id, event_id, ts, value, props,
         CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'started' END AS status
  FROM events),
runs AS (
  SELECT run_id, min(ts) FILTER (status = 'started') AS started,
         max(ts) FILTER (status <> 'started') AS ended,
         arg_max(status, ts) FILTER (status <> 'started') AS status,
         arg_max(event_id, ts) FILTER (status <> 'started') AS source_count,
         arg_max(CAST(floor(value) AS BIGINT), ts) FILTER (status <> 'started') AS loaded,
         arg_max(CASE WHEN status = 'failed' THEN props ELSE '' END, ts) FILTER (status <> 'started') AS error_message
  FROM e GROUP BY run_id)
"""


@query(
    "run_records",
    RUNS_SQL
    + """
SELECT run_id, coalesce(status, 'started') AS status, CAST(started AS VARCHAR) AS started_at,
       CAST(ended AS VARCHAR) AS completed_at,
       (epoch_us(ended) - epoch_us(started)) / 1e6 AS duration_seconds,
       coalesce(source_count, 0) AS source_count, coalesce(loaded, 0) AS total_rows_loaded,
       nullif(error_message, '') AS error_message
FROM runs
""",
)
def run_records_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = run_records(run_events(spark, sf_dir))
    return records.select(
        "run_id",
        "status",
        F.col("started_at").cast("string").alias("started_at"),
        F.col("completed_at").cast("string").alias("completed_at"),
        "duration_seconds",
        "source_count",
        "total_rows_loaded",
        "error_message",
    )


@query(
    "run_lookup",
    RUNS_SQL
    + """
SELECT run_id, coalesce(status, 'started') AS status FROM runs
WHERE run_id = (SELECT arg_min(run_id, event_id) FROM e)
""",
)
def run_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that the first event belongs to."""
    events = run_events(spark, sf_dir)
    first = events.agg(F.min_by("run_id", "event_id")).first()[0]
    return get_run(run_records(events), first).select("run_id", "status")


@query(
    "recent_runs",
    RUNS_SQL
    + "SELECT run_id, coalesce(status, 'started') AS status FROM runs ORDER BY started DESC NULLS LAST, run_id LIMIT 50",
)
def recent_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recent_runs(run_records(run_events(spark, sf_dir))).select("run_id", "status")


@query(
    "run_retention",
    "SELECT event_id FROM events WHERE ts >= (TIMESTAMP '2024-03-31 12:00:00' - INTERVAL 90 DAY)",
)
def run_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return younger_than(events, "ts", 90, now=datetime(2024, 3, 31, 12)).select("event_id")


@query(
    "run_totals",
    """
SELECT CAST(l_suppkey AS VARCHAR) AS run_id,
       CAST(sum(CASE WHEN l_returnflag <> 'R' THEN CAST(l_quantity AS BIGINT) + l_linenumber ELSE 0 END) AS BIGINT) AS total_rows_loaded,
       CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS total_rows_invalid,
       count(*) AS table_count, count(nullif(l_returnflag, 'A')) AS failed_tables
FROM lineitem GROUP BY l_suppkey
""",
)
def run_totals_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items read as the loads of one run per supplier."""
    loads = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("run_id"),
        F.when(F.col("l_returnflag") == "R", "derived").otherwise("canonical").alias("table_kind"),
        F.col("l_quantity").cast("long").alias("inserted_rows"),
        F.col("l_linenumber").cast("long").alias("updated_rows"),
        (F.col("l_linestatus") == "O").cast("long").alias("invalid_rows"),
        F.nullif("l_returnflag", F.lit("A")).alias("error"),
    )
    return run_totals(loads)


@query(
    "lineage_files",
    """
SELECT 'run-1' AS run_id, 'file' AS event_type, 'orders.parquet' AS source_file, 'orders' AS target_ref,
       'read' AS stage, 'orders' AS table_name
""",
)
def lineage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = scan(spark, f"{sf_dir}/orders.parquet")
    return file_events(read, "run-1", "orders").select(
        "run_id",
        "event_type",
        F.substring_index("source_ref", "/", -1).alias("source_file"),
        "target_ref",
        "stage",
        "table_name",
    )


@query(
    "lineage_events",
    """
SELECT * FROM (VALUES ('file', 'unknown', 'clients', 'read', NULL, 'clients'),
  ('hook', 'clients', 'clients', 'transform', 'clean_clients', 'clients'),
  ('output', 'clients', 'clients', 'load', NULL, 'clients'),
  ('output', 'segments', 'segments', 'derive', NULL, 'segments'),
  ('output', 'clients', 'semantic::client_semantics', 'semantic', NULL, 'clients'),
  ('output', 'segments', 'semantic::segment_semantics', 'semantic', NULL, 'segments'))
  t(event_type, source_ref, target_ref, stage, hook_name, table_name)
""",
)
def lineage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    run_clients(store, raw_clients(spark, sf_dir), "run-1")
    events = lineage_of(store.read("etl_lineage"), run_id="run-1")
    return events.select(
        "event_type", "source_ref", "target_ref", "stage", "hook_name", "table_name"
    )
