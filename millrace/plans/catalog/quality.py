"""Queries on row rules, quarantine, duplicates, orphans and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.difference import row_difference
from millrace.operators.merge import orphan_keys, orphan_rows
from millrace.operators.quality import (
    ERROR_FLAG,
    ERROR_TEXT,
    allowed_values,
    apply_rules,
    castable_rules,
    error_histogram,
    flag_rows,
    invalid_rows,
    mark_duplicates,
    non_negative,
    parsable_date,
    quarantine_rows,
    quarantined,
    reconcile,
    split_counts,
    valid_rows,
)
from millrace.plans.catalog.registry import query, table
from millrace.scratch import Scratch
from millrace.spec import Column, TableSpec

CUSTOMER_SPEC = TableSpec(
    "customers",
    (
        Column("c_custkey", "int", key=True),
        Column("c_name", "str", nullable=False),
        Column("c_mktsegment", "str", nullable=False),
        Column("c_nationkey", "int"),
    ),
)

LINE_SPEC = TableSpec(
    "lines",
    (
        Column("l_orderkey", "int", key=True),
        Column("l_linenumber", "int", key=True),
        Column("l_returnflag", "str", nullable=False),
        Column("l_quantity", "float"),
    ),
)

CUSTOMER_ERRORS = """
WITH flagged AS (
  SELECT c_custkey, concat_ws('; ',
    CASE WHEN nullif(c_name, 'Customer#000000003') IS NULL
         THEN 'Column ''c_name'' is required but null.' END,
    CASE WHEN nullif(c_mktsegment, 'BUILDING') IS NULL
         THEN 'Column ''c_mktsegment'' is required but null.' END) AS errors
  FROM customer)
"""

LINE_ERRORS = """
WITH flagged AS (
  SELECT *, concat_ws('; ',
    CASE WHEN nullif(l_returnflag, 'R') IS NULL
         THEN 'Column ''l_returnflag'' is required but null.' END,
    CASE WHEN count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1
         THEN 'Duplicate primary key on columns [''l_orderkey'', ''l_linenumber''].' END) AS errors
  FROM lineitem)
"""


def flagged_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"),
        "l_quantity",
        *more,
    )
    return flag_rows(lines, LINE_SPEC, scratch=Scratch(spark))


@query(
    "validate_required",
    CUSTOMER_ERRORS + "SELECT c_custkey, errors, CAST(errors <> '' AS INTEGER) AS failed FROM flagged",
)
def validate_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").withColumns(
        {
            "c_name": F.nullif("c_name", F.lit("Customer#000000003")),
            "c_mktsegment": F.nullif("c_mktsegment", F.lit("BUILDING")),
        }
    )
    flagged = flag_rows(customers, CUSTOMER_SPEC, scratch=Scratch(spark))
    return flagged.select(
        "c_custkey", F.col(ERROR_TEXT).alias("errors"), F.col(ERROR_FLAG).cast("int").alias("failed")
    )


@query(
    "validate_duplicate_key",
    LINE_ERRORS + "SELECT l_orderkey, l_linenumber, l_quantity, errors FROM flagged WHERE errors <> ''",
)
def validate_duplicate_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invalid_rows(flagged_lines(spark, sf_dir)).select(
        "l_orderkey", "l_linenumber", "l_quantity", F.col(ERROR_TEXT).alias("errors")
    )


@query(
    "validate_duplicate_null_key",
    """
SELECT event_id, CAST(count(*) OVER (PARTITION BY nullif(event_type, 'view'), user_id) > 1 AS INTEGER)
  AS duplicated
FROM events
""",
)
def validate_duplicate_null_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_id", F.nullif("event_type", F.lit("view")).alias("kind"), "user_id"
    )
    marked = mark_duplicates(events, ["kind", "user_id"], scratch=Scratch(spark))
    return marked.select("event_id", F.col("_duplicated").cast("int").alias("duplicated"))


@query(
    "validate_valid_rows",
    LINE_ERRORS + "SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity FROM flagged WHERE errors = ''",
)
def validate_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valid_rows(flagged_lines(spark, sf_dir))


@query(
    "validate_split_counts",
    LINE_ERRORS
    + """
SELECT count(*) AS total_rows, count(*) FILTER (errors = '') AS valid_rows,
       count(*) FILTER (errors <> '') AS invalid_rows FROM flagged
""",
)
def validate_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_counts(flagged_lines(spark, sf_dir))


@query(
    "error_histogram",
    LINE_ERRORS
    + """
SELECT message, count(*) AS row_count
FROM (SELECT unnest(string_split(errors, '; ')) AS message FROM flagged WHERE errors <> '')
GROUP BY message
""",
)
def error_histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return error_histogram(flagged_lines(spark, sf_dir))


@query(
    "quarantine_rows",
    LINE_ERRORS
    + """
SELECT 'run-1' AS run_id, 'validation' AS stage, 'warehouse' AS source_id, 'lines' AS table_name,
       CAST(to_json({'l_orderkey': l_orderkey, 'l_linenumber': l_linenumber,
                'l_returnflag': nullif(l_returnflag, 'R'), 'l_quantity': l_quantity,
                'l_shipdate': CAST(l_shipdate AS VARCHAR)}) AS VARCHAR) AS raw_row_json,
       errors AS error_message
FROM flagged WHERE errors <> ''
""",
)
def quarantine_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = quarantine_rows(
        invalid_rows(flagged_lines(spark, sf_dir, "l_shipdate")),
        run_id="run-1",
        stage="validation",
        source_id="warehouse",
        table_name="lines",
    )
    return quarantined(rejected, run_id="run-1", table_name="lines").drop("persisted_at")


@query(
    "validate_castable",
    """
SELECT event_id, concat_ws('; ',
   CASE WHEN TRY_CAST(event_type AS INTEGER) IS NULL THEN 'Column ''event_type'' is not a valid int.' END,
   CASE WHEN value <> floor(value) THEN 'Column ''value'' is not a valid int.' END) AS errors
FROM events
""",
)
def validate_castable(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = TableSpec("events", (Column("event_type", "int"), Column("value", "int")))
    events = table(spark, sf_dir, "events")
    flagged = apply_rules(events, castable_rules(events, spec))
    return flagged.select("event_id", F.col(ERROR_TEXT).alias("errors"))


@query(
    "validate_value_rules",
    """
SELECT c_custkey, concat_ws('; ',
   CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'Column ''c_mktsegment'' has a value that is not allowed.' END,
   CASE WHEN c_acctbal < 0 THEN 'Column ''c_acctbal'' is negative.' END,
   CASE WHEN c_mktsegment <> 'MACHINERY' THEN 'Column ''opened'' is not a date.' END) AS errors
FROM customer
""",
)
def validate_value_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    customers = table(spark, sf_dir, "customer").withColumn(
        "opened", F.when(segment == "MACHINERY", F.lit("2024-02-29")).otherwise(F.lit("2023-02-29"))
    )
    rules = [
        allowed_values("c_mktsegment", ["BUILDING", "MACHINERY"]),
        non_negative("c_acctbal"),
        parsable_date("opened"),
    ]
    return apply_rules(customers, rules).select("c_custkey", F.col(ERROR_TEXT).alias("errors"))


@query(
    "reconcile_totals",
    """
WITH lines AS (
  SELECT l_orderkey AS order_key, count(*) AS n, sum(CAST(l_quantity AS DECIMAL(18,2))) AS q
  FROM lineitem GROUP BY ALL),
heads AS (
  SELECT o_orderkey AS order_key, count(*) AS n, sum(CAST(10 AS DECIMAL(18,2))) AS q
  FROM orders GROUP BY ALL)
SELECT coalesce(l.order_key, h.order_key) AS order_key, h.n AS source_rows, l.n AS target_rows,
       CAST(h.q AS DOUBLE) AS source_quantity, CAST(l.q AS DOUBLE) AS target_quantity
FROM heads h FULL OUTER JOIN lines l ON h.order_key = l.order_key
WHERE h.n IS DISTINCT FROM l.n OR h.q IS DISTINCT FROM l.q
""",
)
def reconcile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.lit(10.0).alias("quantity")
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_quantity").alias("quantity")
    )
    found = reconcile(heads, lines, ["order_key"], ["quantity"])
    return found.withColumns(
        {c: F.col(c).cast("double") for c in ("source_quantity", "target_quantity")}
    )


@query(
    "reconcile_rows",
    """
WITH heads AS (SELECT o_orderkey AS order_key, o_orderstatus AS status FROM orders),
lines AS (
  SELECT l_orderkey AS order_key, CASE WHEN min(l_linestatus) = max(l_linestatus)
    THEN min(l_linestatus) ELSE 'P' END AS status
  FROM lineitem GROUP BY l_orderkey)
SELECT order_key, status, sum(s) AS source_rows, sum(t) AS target_rows FROM (
  SELECT order_key, status, 1 AS s, 0 AS t FROM heads
  UNION ALL SELECT order_key, status, 0, 1 FROM lines)
GROUP BY order_key, status HAVING sum(s) <> sum(t)
""",
)
def reconcile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose status is not the one their lines give them."""
    heads = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_orderstatus").alias("status")
    )
    low, high = F.min("l_linestatus"), F.max("l_linestatus")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(
        F.when(low == high, low).otherwise("P").alias("status")
    )
    return row_difference(heads, lines, ["order_key"], scratch=Scratch(spark))


@query(
    "orphan_report",
    """
SELECT o_orderkey, count(*) AS child_rows FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderkey
""",
)
def orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_keys(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), ["o_orderkey"], ["l_orderkey"]
    )


@query(
    "orphan_rows",
    """
SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem
WHERE l_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""",
)
def orphan_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    in_credit = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return orphan_rows(lines, in_credit, ["l_suppkey"], ["c_custkey"], scratch=Scratch(spark))
