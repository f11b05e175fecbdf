"""Queries on hashes, keys, cleaning, unions, projections and derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.cleaning import guarded_ratio
from millrace.functions.keys import concat_key, hash_all_columns, prefixed_id, with_record_hash
from millrace.operators.derive import (
    Transform,
    group_stats,
    group_sums,
    ordered_distinct,
    run_chain,
    share_of_total,
)
from millrace.operators.shape import (
    clean,
    dedupe,
    fill_missing,
    fill_required_defaults,
    normalise_transactions,
    relaxed_union,
    target_projection,
    where_equal,
)
from millrace.plans.catalog.registry import money, query, table
from millrace.spec import Column, FrameContract, TableSpec


def segment_stats(customers: DataFrame) -> DataFrame:
    return group_stats(
        customers,
        "segment",
        count="customer_count",
        total=("balance", "total_balance"),
        mean=("nation", "avg_nation"),
    )


def clean_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        money("c_acctbal").alias("balance"),
    )
    return clean(raw, uppers={"segment": "Unknown"})


SEGMENTS_SQL = """
WITH cleaned AS (
  SELECT c_nationkey AS nation, upper(coalesce(c_mktsegment, 'Unknown')) AS segment,
         CAST(c_acctbal AS DECIMAL(18,2)) AS balance
  FROM customer),
stats AS (
  SELECT segment, count(*) AS customer_count, CAST(sum(balance) AS DOUBLE) AS total_balance,
         CAST(trunc(avg(nation)) AS INTEGER) AS avg_nation
  FROM cleaned GROUP BY segment)
"""


@query(
    "derived_share_of_segment",
    SEGMENTS_SQL
    + """
, parts AS (
  SELECT nation, segment, CAST(sum(balance) AS DOUBLE) AS nation_balance
  FROM cleaned GROUP BY nation, segment)
SELECT p.nation, p.segment, p.nation_balance, s.total_balance AS global_segment_balance,
       CASE WHEN coalesce(s.total_balance, 0) > 0 THEN p.nation_balance / s.total_balance
            ELSE 0.0 END AS percent_of_global
FROM parts p LEFT JOIN stats s ON p.segment = s.segment
""",
)
def derived_share_of_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = clean_customers(spark, sf_dir)
    parts = group_sums(customers, ["nation", "segment"], nation_balance="balance")
    totals = group_sums(parts, ["segment"], total_balance="nation_balance")
    shares = share_of_total(
        parts,
        totals,
        "segment",
        part="nation_balance",
        whole="total_balance",
        whole_as="global_segment_balance",
        share="percent_of_global",
    )
    return shares.withColumns(
        {c: F.col(c).cast("double") for c in ("nation_balance", "global_segment_balance")}
    )


@query("derived_segment_stats", SEGMENTS_SQL + "SELECT * FROM stats")
def derived_segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment_stats(clean_customers(spark, sf_dir)).withColumn(
        "total_balance", F.col("total_balance").cast("double")
    )


@query(
    "share_of_flag_by_supplier",
    """
WITH parts AS (
  SELECT l_suppkey, l_returnflag, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty
  FROM lineitem GROUP BY ALL),
totals AS (
  SELECT l_returnflag, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty FROM lineitem GROUP BY ALL)
SELECT p.l_returnflag, p.l_suppkey, CAST(p.qty AS DOUBLE) AS supplier_qty,
       CAST(t.qty AS DOUBLE) AS flag_qty,
       CASE WHEN t.qty > 0 THEN CAST(p.qty AS DOUBLE) / CAST(t.qty AS DOUBLE) ELSE 0.0 END AS share
FROM parts p LEFT JOIN totals t ON p.l_returnflag = t.l_returnflag
""",
)
def share_of_flag_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", money("l_quantity").alias("qty")
    )
    parts = group_sums(lines, ["l_suppkey", "l_returnflag"], qty="qty")
    # The totals come from the parts: three flags over millions of rows would
    # otherwise be summed twice.
    totals = group_sums(parts, ["l_returnflag"], flag_total="qty")
    shared = share_of_total(
        parts.withColumnRenamed("qty", "supplier_qty"),
        totals,
        "l_returnflag",
        part="supplier_qty",
        whole="flag_total",
        whole_as="flag_qty",
        share="share",
    )
    return shared.withColumns(
        {c: F.col(c).cast("double") for c in ("supplier_qty", "flag_qty")}
    )


@query(
    "group_stats_trunc_mean",
    """
SELECT o_orderpriority, count(*) AS order_count,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price,
       CAST(trunc(avg(o_custkey)) AS INTEGER) AS avg_customer
FROM orders GROUP BY o_orderpriority
""",
)
def group_stats_trunc_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("price", money("o_totalprice"))
    stats = group_stats(
        orders,
        "o_orderpriority",
        count="order_count",
        total=("price", "total_price"),
        mean=("o_custkey", "avg_customer"),
    )
    return stats.withColumn("total_price", F.col("total_price").cast("double"))


@query(
    "group_sums_two_keys",
    """
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity
FROM lineitem GROUP BY l_returnflag, l_linestatus
""",
)
def group_sums_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("qty", money("l_quantity"))
    sums = group_sums(lines, ["l_returnflag", "l_linestatus"], quantity="qty")
    return sums.withColumn("quantity", F.col("quantity").cast("double"))


@query(
    "record_hash_64",
    """
SELECT o_orderkey, sha256(concat_ws('||', coalesce(CAST(o_orderkey AS VARCHAR), ''),
  coalesce(CAST(o_custkey AS VARCHAR), ''), coalesce(nullif(o_orderstatus, 'P'), ''),
  coalesce(CAST(o_totalprice AS VARCHAR), ''), coalesce(CAST(o_orderdate AS VARCHAR), ''),
  coalesce(o_orderpriority, ''))) AS _record_hash
FROM orders
""",
)
def record_hash_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn(
        "o_orderstatus", F.nullif("o_orderstatus", F.lit("P"))
    )
    columns = [*orders.columns, "not_in_the_frame"]
    return with_record_hash(orders, columns).select("o_orderkey", "_record_hash")


@query(
    "record_hash_32",
    """
SELECT c_custkey, substr(sha256(concat_ws('||', CAST(c_custkey AS VARCHAR), c_name,
  CAST(c_nationkey AS VARCHAR), CAST(c_acctbal AS VARCHAR), c_mktsegment)), 1, 32) AS _record_hash
FROM customer
""",
)
def record_hash_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    hashed = with_record_hash(customers, customers.columns, length=32)
    return hashed.select("c_custkey", "_record_hash")


@query(
    "hash_record_transform",
    """
SELECT p_partkey, sha256(concat_ws('|', CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type,
  CAST(p_size AS VARCHAR), CAST(p_retailprice AS VARCHAR))) AS row_digest
FROM part
""",
)
def hash_record_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("_source_file", F.lit("left out"))
    return hash_all_columns(parts, target="row_digest").select("p_partkey", "row_digest")


@query(
    "concat_key",
    """
SELECT l_orderkey, l_linenumber, concat(CAST(l_orderkey AS VARCHAR), '_',
  CAST(l_linenumber AS VARCHAR), '_', coalesce(nullif(l_returnflag, 'R'), '')) AS line_key
FROM lineitem
""",
)
def concat_key_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn(
        "flag", F.nullif("l_returnflag", F.lit("R"))
    )
    keyed = concat_key(lines, ["l_orderkey", "l_linenumber", "flag"], "line_key")
    return keyed.select("l_orderkey", "l_linenumber", "line_key")


@query(
    "prefixed_id",
    """
SELECT o_orderkey, concat('INV-', o_orderstatus, '-', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), '-',
  coalesce(CAST(nullif(o_custkey, 1) AS VARCHAR), '')) AS canonical_id
FROM orders
""",
)
def prefixed_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trades = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("symbol"),
        F.to_date("o_orderdate").alias("trade_date"),
        F.nullif("o_custkey", F.lit(1)).alias("account_name"),
    )
    named = prefixed_id(trades, ["symbol", "trade_date", "account_name"], "canonical_id")
    return named.select("o_orderkey", "canonical_id")


@query(
    "clean_cast_fill_upper",
    """
SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 1900) AS k,
       coalesce(TRY_CAST(event_type AS INTEGER), 0) AS type_code,
       upper(coalesce(nullif(event_type, 'view'), 'Unknown')) AS event_type
FROM events
""",
)
def clean_cast_fill_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.col("event_type").alias("type_code"),
        F.nullif("event_type", F.lit("view")).alias("event_type"),
    )
    return clean(
        raw, casts={"k": ("int", 1900), "type_code": ("int", 0)}, uppers={"event_type": "Unknown"}
    )


@query(
    "conditional_ratio",
    """
SELECT event_id, CASE WHEN coalesce(user_id, 0) > 0 THEN value / user_id ELSE 0.0 END AS ratio
FROM events
""",
)
def conditional_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", guarded_ratio(F.col("value"), F.col("user_id")).alias("ratio"))


@query(
    "rename_and_literals",
    """
SELECT c_custkey AS id, c_name AS name, 'crm' AS origin, CAST(1 AS INTEGER) AS revision FROM customer
""",
)
def rename_and_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("id"), "c_name")
        .withColumnRenamed("c_name", "name")
        .withColumns({"origin": F.lit("crm"), "revision": F.lit(1)})
    )


@query(
    "equality_filters",
    """
SELECT o_orderkey, o_custkey FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'
""",
)
def equality_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = where_equal(
        table(spark, sf_dir, "orders"),
        o_orderstatus="F",
        o_orderpriority="1-URGENT",
        o_custkey=None,
    )
    return found.select("o_orderkey", "o_custkey")


PARTS_SPEC = TableSpec(
    "parts",
    (
        Column("p_partkey", "int", key=True),
        Column("p_size", "str"),
        Column("p_retailprice", "int"),
        Column("is_large", "bool"),
        Column("currency", "str", default="EUR"),
        Column("weight", "float"),
        Column("grade", "str", nullable=False, default="B"),
    ),
    kind="derived",
    depends_on=("part",),
)


@query(
    "missing_column_fill",
    """
SELECT p_partkey, CAST(p_size AS INTEGER) AS p_size, p_retailprice, 'EUR' AS currency,
       CAST(NULL AS DOUBLE) AS weight,
       coalesce(nullif(p_type, 'ECONOMY'), 'B') AS grade, CAST(NULL AS BOOLEAN) AS is_large
FROM part
""",
)
def missing_column_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        "p_size",
        "p_retailprice",
        F.nullif("p_type", F.lit("ECONOMY")).alias("grade"),
    )
    filled = fill_required_defaults(fill_missing(parts, PARTS_SPEC), PARTS_SPEC)
    return filled.select(
        "p_partkey", "p_size", "p_retailprice", "currency", "weight", "grade", "is_large"
    )


@query(
    "target_projection",
    """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size,
       CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(p_retailprice AS BIGINT) END
         AS p_retailprice,
       CAST(p_size > 25 AS BIGINT) AS is_large, CAST(NULL AS VARCHAR) AS currency,
       CAST(NULL AS DOUBLE) AS weight, p_brand AS grade
FROM part
""",
)
def target_projection_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumns(
        {"is_large": F.col("p_size") > 25, "grade": F.col("p_brand")}
    )
    return target_projection(parts, PARTS_SPEC)


@query(
    "normalise_transactions",
    """
SELECT l_orderkey, l_linenumber, upper(lower(l_linestatus)) AS symbol, trim('  acct ' || l_returnflag || ' ') AS account_name,
       CASE l_returnflag WHEN 'A' THEN 'BUY' WHEN 'N' THEN 'SELL' ELSE 'FEE' END AS transaction_type,
       l_quantity - 1 AS quantity
FROM lineitem
WHERE l_returnflag IN ('A', 'N') AND l_quantity - 1 <> 0
""",
)
def normalise_transactions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    trades = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.lower("l_linestatus").alias("symbol"),
        F.concat(F.lit("  acct "), flag, F.lit(" ")).alias("account_name"),
        F.when(flag == "A", "BUY").when(flag == "N", "SELL").otherwise("FEE").alias("transaction_type"),
        (F.col("l_quantity") - 1).alias("quantity"),
    )
    return normalise_transactions(trades)


@query(
    "relaxed_union",
    """
SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation,
       c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL
SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name, 'N' || CAST(s_nationkey AS VARCHAR), s_acctbal, NULL FROM supplier
UNION ALL
SELECT CAST(p_partkey AS VARCHAR), p_name, NULL, CAST(p_size AS DOUBLE), NULL FROM part
""",
)
def relaxed_union_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").toDF("id", "name", "nation", "balance", "segment")
    suppliers = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("N"), F.col("s_nationkey")).alias("nation"),
        F.col("s_acctbal").alias("balance"),
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("balance")
    )
    return relaxed_union([customers, suppliers, None, parts])


@query("dedupe_before_load", "SELECT DISTINCT conv_id, turn, role, text FROM conversations")
def dedupe_before_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return dedupe(turns.unionAll(turns), ["conv_id", "turn", "role", "text"])


@query(
    "ordered_refs",
    "SELECT event_type AS ref, min(event_id) AS position FROM events GROUP BY event_type",
)
def ordered_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("ref"), F.col("event_id").alias("position")
    )
    return ordered_distinct(refs, "ref", "position")


def _with_band(df: DataFrame, size: int) -> DataFrame:
    return df.withColumn("band", F.floor(F.col("c_acctbal") / size).cast("long"))


def _needs_absent_column(df: DataFrame) -> DataFrame:
    return df.withColumn("broken", F.col("no_such_column") + 1)


def _label(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("label", F.concat(F.lit(text), F.col("band").cast("string")))


@query(
    "transform_chain",
    """
SELECT c_custkey, CAST(floor(c_acctbal / 1000) AS BIGINT) AS band,
       concat('band ', CAST(CAST(floor(c_acctbal / 1000) AS BIGINT) AS VARCHAR)) AS label
FROM customer
""",
)
def transform_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    adds_band = FrameContract(requires=("c_acctbal",), provides=("band",), mutation="adds_columns")
    chain = [
        Transform(_label, params={"text": "band "}, order=30),
        Transform(_with_band, params={"size": 1000}, order=10, contract=adds_band),
        Transform(_needs_absent_column, order=20, on_failure="skip_hook"),
        Transform(_with_band, name="switched_off", params={"size": 1}, order=15, enabled=False),
    ]
    return run_chain(customers, chain).select("c_custkey", "band", "label")
