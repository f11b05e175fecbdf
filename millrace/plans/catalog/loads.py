"""Queries on append, replace, upsert and whole runs over stored tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import with_record_hash
from millrace.operators.audit import run_records
from millrace.operators.derive import Transform
from millrace.operators.maintain import GroupStates
from millrace.operators.merge import changed_rows, key_collisions, merge_counts, merge_rows
from millrace.operators.quality import quarantined
from millrace.operators.shape import clean, target_projection
from millrace.plans.catalog.registry import query, table
from millrace.plans.catalog.shape import segment_stats
from millrace.plans.jobs import (
    RUN_TABLE,
    CanonicalTable,
    DerivedTable,
    Source,
    load_results,
    run_project,
)
from millrace.scratch import Scratch
from millrace.sources.tables import KeyCollision, TableStore
from millrace.spec import Column, DocumentSpec, TableSpec, gate_errors

PARTY_COLUMNS = ("id", "name", "nation", "balance")

PARTIES = TableSpec(
    "parties",
    (
        Column("id", "int", key=True),
        Column("name", "str"),
        Column("nation", "int"),
        Column("balance", "float"),
    ),
    kind="derived",
    depends_on=("crm",),
    load_mode="upsert",
)

PARTIES_SQL = """
WITH old AS (SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS nation, s_acctbal AS balance FROM supplier),
new AS (SELECT c_custkey AS id, c_name AS name, CAST(c_nationkey AS BIGINT) AS nation, c_acctbal AS balance FROM customer)
"""


def parties(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Suppliers or customers in one layout; their ids overlap."""
    columns = table(spark, sf_dir, name).columns[:4]
    return (
        table(spark, sf_dir, name)
        .select(*[F.col(c).alias(n) for c, n in zip(columns, PARTY_COLUMNS, strict=True)])
        .withColumn("nation", F.col("nation").cast("long"))
    )


def new_store(spark: SparkSession) -> TableStore:
    return TableStore(spark, Scratch(spark).path("store"))


@query(
    "append_rows",
    PARTIES_SQL + "SELECT -1 - id AS id, name, nation, balance FROM old UNION ALL SELECT * FROM new",
)
def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    old = parties(spark, sf_dir, "supplier").withColumn("id", -1 - F.col("id"))
    store.write(PARTIES, old, "append")
    store.write(PARTIES, parties(spark, sf_dir, "customer"), "append")
    return store.read("parties")


@query("append_collisions", PARTIES_SQL + "SELECT id FROM new WHERE id IN (SELECT id FROM old)")
def append_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_collisions(
        parties(spark, sf_dir, "supplier"), parties(spark, sf_dir, "customer"), ["id"]
    )


@query("append_refused", PARTIES_SQL + "SELECT * FROM old")
def append_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append with known keys fails as a whole: the table stays as it was."""
    store = new_store(spark)
    store.write(PARTIES, parties(spark, sf_dir, "supplier"), "append")
    try:
        store.write(PARTIES, parties(spark, sf_dir, "customer"), "append")
    except KeyCollision:
        return store.read("parties")
    raise AssertionError("The append should have been refused.")


@query("replace_rows", PARTIES_SQL + "SELECT * FROM new")
def replace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    store.write(PARTIES, parties(spark, sf_dir, "supplier"), "replace")
    store.write(PARTIES, parties(spark, sf_dir, "customer"), "replace")
    return store.read("parties")


@query(
    "upsert_rows",
    """
WITH batch AS (
  SELECT l_orderkey AS order_key, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price
  FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS order_key, o_totalprice AS price FROM orders
WHERE o_orderkey NOT IN (SELECT order_key FROM batch)
UNION ALL SELECT * FROM batch
""",
)
def upsert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price")
    )
    return merge_rows(target, order_totals(spark, sf_dir), ["order_key"])


def order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order_key"))
        .agg(price.alias("price"))
    )


@query(
    "upsert_stored_rows",
    PARTIES_SQL + "SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new",
)
def upsert_stored_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    store.write(PARTIES, parties(spark, sf_dir, "supplier"))
    store.write(PARTIES, parties(spark, sf_dir, "customer"))
    return store.read("parties")


@query(
    "upsert_counts",
    """
SELECT count(*) FILTER (o.o_orderkey IS NULL) AS inserted_rows,
       count(*) FILTER (o.o_orderkey IS NOT NULL) AS updated_rows,
       count(*) FILTER (o.o_orderkey IS NOT NULL AND o.o_totalprice IS DISTINCT FROM b.price) AS changed_rows
FROM (SELECT o_orderkey AS order_key,
             CASE WHEN o_orderstatus = 'P' THEN 0.5 ELSE o_totalprice END AS price FROM orders
      UNION ALL SELECT -1 - p_partkey, p_retailprice FROM part) b
LEFT JOIN orders o ON o.o_orderkey = b.order_key
""",
)
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, batch = stored_and_revised_orders(spark, sf_dir)
    return merge_counts(target, batch, ["order_key"], hash_column="_record_hash")


def stored_and_revised_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders; and all orders with the open ones repriced, plus new keys from the parts."""
    orders = table(spark, sf_dir, "orders")
    stored = orders.select(
        F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price")
    )
    repriced = F.when(F.col("o_orderstatus") == "P", 0.5).otherwise(F.col("o_totalprice"))
    revised = orders.select(F.col("o_orderkey").alias("order_key"), repriced.alias("price"))
    added = table(spark, sf_dir, "part").select(
        (-1 - F.col("p_partkey")).alias("order_key"), F.col("p_retailprice").alias("price")
    )
    columns = ["order_key", "price"]
    return (
        with_record_hash(stored, columns),
        with_record_hash(revised.unionByName(added), columns),
    )


@query(
    "changed_rows",
    """
SELECT o_orderkey AS order_key, 0.5 AS price FROM orders WHERE o_orderstatus = 'P' AND o_totalprice <> 0.5
UNION ALL SELECT -1 - p_partkey, p_retailprice FROM part
""",
)
def changed_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, batch = stored_and_revised_orders(spark, sf_dir)
    return changed_rows(target, batch, ["order_key"]).select("order_key", "price")


CLIENTS = TableSpec(
    "clients",
    (
        Column("id", "str", key=True),
        Column("name", "str"),
        Column("segment", "str", indexed=True),
        Column("nation", "int"),
        Column("balance", "int"),
    ),
    load_mode="upsert",
    record_hash=True,
)

SEGMENTS = TableSpec(
    "segments",
    (
        Column("segment", "str", key=True),
        Column("customer_count", "int"),
        Column("total_balance", "int"),
        Column("avg_nation", "int"),
    ),
    kind="derived",
    depends_on=("clients",),
    load_mode="replace",
    record_hash=True,
)

CLIENT_DOCUMENTS = DocumentSpec(
    "client_semantics",
    "clients",
    "{name} is a client in the {segment} segment of nation {nation}. Their balance is {balance}.",
    title_template="Client: {name}",
    source_pk="id",
    metadata_fields=("id", "segment", "nation"),
    tag_fields=("segment",),
    chunk_size=40,
    chunk_overlap=10,
)

SEGMENT_DOCUMENTS = DocumentSpec(
    "segment_semantics",
    "segments",
    "The {segment} segment has {customer_count} clients with a total balance of {total_balance}.",
    title_template="Segment: {segment}",
    source_pk="segment",
    metadata_fields=("segment", "customer_count"),
    tag_fields=("segment",),
    chunk_size=500,
    chunk_overlap=50,
)


def raw_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as text, the way an untyped source delivers them."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"),
        F.col("c_name").alias("name"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"),
        F.floor("c_acctbal").cast("string").alias("balance"),
    )


def revised_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clients, those of nation 3 with a new balance, plus the suppliers as new ones."""
    revised = raw_clients(spark, sf_dir).withColumn(
        "balance", F.when(F.col("nation") == "3", F.lit("9999")).otherwise(F.col("balance"))
    )
    added = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("id"),
        F.col("s_name").alias("name"),
        F.lit("Testing").alias("segment"),
        F.lit("2026.0").alias("nation"),
        F.lit("42").alias("balance"),
    )
    return revised.unionByName(added)


def clean_clients(df: DataFrame) -> DataFrame:
    return clean(
        df, casts={"nation": ("int", 1900), "balance": ("int", 0)}, uppers={"segment": "Unknown"}
    )


def run_clients(
    store: TableStore, rows: DataFrame, run_id: str, *, index: bool = True, documents=None
):
    return run_project(
        store,
        project_id="clients",
        canonical=[
            CanonicalTable(
                CLIENTS,
                (Source("crm", lambda spark: rows),),
                before_validation=(Transform(clean_clients, order=10),),
            )
        ],
        derived=[DerivedTable(SEGMENTS, lambda frames: segment_stats(frames["clients"]))],
        documents=(documents or [CLIENT_DOCUMENTS, SEGMENT_DOCUMENTS]) if index else [],
        run_id=run_id,
    )


CLIENTS_SQL = """
WITH clients AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
         upper(coalesce(nullif(c_mktsegment, 'BUILDING'), 'Unknown')) AS segment,
         CAST(c_nationkey AS BIGINT) AS nation, CAST(floor(c_acctbal) AS BIGINT) AS balance,
         sha256(concat_ws('||', CAST(c_custkey AS VARCHAR), c_name,
           coalesce(nullif(c_mktsegment, 'BUILDING'), ''), CAST(c_nationkey AS VARCHAR),
           CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR))) AS _record_hash
  FROM customer)
"""

REVISED_SQL = """
WITH clients AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name,
         upper(coalesce(nullif(c_mktsegment, 'BUILDING'), 'Unknown')) AS segment,
         CAST(c_nationkey AS BIGINT) AS nation,
         CASE WHEN c_nationkey = 3 THEN 9999 ELSE CAST(floor(c_acctbal) AS BIGINT) END AS balance
  FROM customer
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name, 'TESTING', 1900, 42 FROM supplier)
"""


@query(
    "idempotent_rerun",
    CLIENTS_SQL + "SELECT id, name, segment, nation, balance, _record_hash FROM clients",
)
def idempotent_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    rows = raw_clients(spark, sf_dir)
    run_clients(store, rows, "run-1")
    run_clients(store, rows, "run-2")
    return store.read("clients").drop("_file_hash", "_source_file")


@query("incremental_rerun", REVISED_SQL + "SELECT id, name, segment, nation, balance FROM clients")
def incremental_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    run_clients(store, raw_clients(spark, sf_dir), "run-1", index=False)
    run_clients(store, revised_clients(spark, sf_dir), "run-2", index=False)
    return store.read("clients").select("id", "name", "segment", "nation", "balance")


@query(
    "incremental_derived",
    REVISED_SQL
    + """
SELECT segment, count(*) AS customer_count, CAST(sum(balance) AS BIGINT) AS total_balance,
       CAST(trunc(avg(nation)) AS BIGINT) AS avg_nation FROM clients GROUP BY segment
""",
)
def incremental_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    run_clients(store, raw_clients(spark, sf_dir), "run-1", index=False)
    run_clients(store, revised_clients(spark, sf_dir), "run-2", index=False)
    return store.read("segments").drop("_record_hash")


MAINTAINED_SEGMENTS = GroupStates(
    ("segment",),
    count="customer_count",
    sums={"total_balance": "balance"},
    means={"avg_nation": "nation"},
)


@query(
    "maintained_derived",
    REVISED_SQL
    + """
SELECT segment, count(*) AS customer_count, CAST(sum(balance) AS BIGINT) AS total_balance,
       CAST(trunc(avg(nation)) AS BIGINT) AS avg_nation
FROM clients WHERE id LIKE 'S%' OR CAST(id AS BIGINT) % 7 > 0 GROUP BY segment
""",
)
def maintained_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment statistics kept up to date from the buckets that later batches touch.

    The first run brings six sevenths of the clients, the second the revised ones of
    one nation and the new ones, each to one of many buckets.
    """
    spec = replace(CLIENTS, buckets=64)
    store = new_store(spark)
    there = F.col("id").startswith("S") | (F.try_to_number("id", F.lit("999999999999")) % 7 > 0)
    revised = revised_clients(spark, sf_dir).filter(there)
    changed = revised.filter(F.col("id").startswith("S") | (F.col("nation") == "3"))
    for run, rows in (("run-1", raw_clients(spark, sf_dir).filter(there)), ("run-2", changed)):
        source = Source("crm", lambda spark, rows=rows: rows)
        run_project(
            store,
            project_id="clients",
            canonical=[CanonicalTable(spec, (source,), before_validation=(Transform(clean_clients),))],
            derived=[DerivedTable(SEGMENTS, maintained=MAINTAINED_SEGMENTS)],
            run_id=run,
        )
    return store.read("segments").drop("_record_hash")


# Chunks of the revised clients and their segments.
INCREMENTAL_INDEX_SQL = (
    REVISED_SQL
    + """
, docs AS (
  SELECT 'client_semantics' AS semantic_id, id AS source_pk, 'Client: ' || name AS title, 40 AS size, 30 AS step,
         name || ' is a client in the ' || segment || ' segment of nation ' || CAST(nation AS VARCHAR)
           || '. Their balance is ' || CAST(balance AS VARCHAR) || '.' AS body
  FROM clients
  UNION ALL
  SELECT 'segment_semantics', segment, 'Segment: ' || segment, 500, 450,
         'The ' || segment || ' segment has ' || CAST(count(*) AS VARCHAR) || ' clients with a total balance of '
           || CAST(CAST(sum(balance) AS BIGINT) AS VARCHAR) || '.'
  FROM clients GROUP BY segment)
SELECT semantic_id, source_pk, title, CAST(p // step AS INTEGER) AS chunk_index,
       substr(body, p + 1, size) AS chunk_text
FROM (SELECT *, unnest(generate_series(CAST(0 AS BIGINT), length(body) - 1, step)) AS p FROM docs)
"""
)


@query("incremental_index", f"SELECT *, 'run-2' AS run_id FROM ({INCREMENTAL_INDEX_SQL})")
def incremental_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    run_clients(store, raw_clients(spark, sf_dir), "run-1")
    run_clients(store, revised_clients(spark, sf_dir), "run-2")
    return store.read("etl_semantic_index").select(
        "semantic_id", "source_pk", "title", "chunk_index", "chunk_text", "run_id"
    )


@query("incremental_index_buckets", INCREMENTAL_INDEX_SQL)
def incremental_index_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same index with only those buckets written whose documents changed."""
    store = new_store(spark)
    documents = [replace(d, index_buckets=16) for d in (CLIENT_DOCUMENTS, SEGMENT_DOCUMENTS)]
    run_clients(store, raw_clients(spark, sf_dir), "run-1", documents=documents)
    run_clients(store, revised_clients(spark, sf_dir), "run-2", documents=documents)
    return store.read("etl_semantic_index").select(
        "semantic_id", "source_pk", "title", "chunk_index", "chunk_text"
    )


@query(
    "load_results",
    """
SELECT 'run-2' AS run_id, 'crm' AS source_id, 'clients' AS table_name, 'canonical' AS table_kind, 'upsert' AS mode,
       (SELECT count(*) FROM supplier) AS inserted_rows, (SELECT count(*) FROM customer) AS updated_rows,
       (SELECT count(*) FROM supplier) + (SELECT count(*) FROM customer) AS total_affected,
       CAST(0 AS BIGINT) AS invalid_rows
UNION ALL
SELECT 'run-2', '', 'segments', 'derived', 'replace',
       (SELECT count(DISTINCT c_mktsegment) + 1 FROM customer), 0,
       (SELECT count(DISTINCT c_mktsegment) + 1 FROM customer), 0
""",
)
def load_results_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    run_clients(store, raw_clients(spark, sf_dir), "run-1", index=False)
    return load_results(
        spark, run_clients(store, revised_clients(spark, sf_dir), "run-2", index=False)
    ).drop("error")


@query(
    "quarantine_of_run",
    """
SELECT 'lines' AS table_name, 'run-1' AS run_id,
       'Duplicate primary key on columns [''l_orderkey'', ''l_linenumber''].' AS error_message,
       count(*) AS row_count
FROM (SELECT count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem)
WHERE n > 1
""",
)
def quarantine_of_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = TableSpec(
        "lines",
        (
            Column("l_orderkey", "int", key=True),
            Column("l_linenumber", "int", key=True),
            Column("l_quantity", "float"),
        ),
        load_mode="append",
    )
    store = new_store(spark)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    run_project(
        store,
        project_id="lines",
        canonical=[CanonicalTable(spec, (Source("warehouse", lambda spark: lines),))],
        run_id="run-1",
    )
    rejected = quarantined(store.read("etl_dlq"), run_id="run-1", table_name="lines")
    return rejected.groupBy("table_name", "run_id", "error_message").agg(
        F.count("*").alias("row_count")
    )


@query(
    "partial_failure",
    """
SELECT 'clients' AS table_name, 1 AS loaded, 0 AS failed
UNION ALL SELECT 'segments', 1, 0 UNION ALL SELECT 'broken', 0, 1
""",
)
def partial_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A derived table that cannot be built leaves the others in place."""
    store = new_store(spark)
    rows = raw_clients(spark, sf_dir)
    broken = TableSpec(
        "broken", (Column("id", "str", key=True),), kind="derived", depends_on=("clients",)
    )
    result = run_project(
        store,
        project_id="clients",
        canonical=[
            CanonicalTable(
                CLIENTS,
                (Source("crm", lambda spark: rows),),
                before_validation=(Transform(clean_clients),),
            )
        ],
        derived=[
            DerivedTable(broken, lambda frames: frames["clients"].select("no_such_column")),
            DerivedTable(SEGMENTS, lambda frames: segment_stats(frames["clients"])),
        ],
        run_id="run-1",
    )
    return load_results(spark, result).select(
        "table_name",
        F.col("mode").isNotNull().cast("int").alias("loaded"),
        F.col("error").isNotNull().cast("int").alias("failed"),
    )


@query(
    "run_failure",
    """
SELECT 'clients' AS table_name, 1 AS loaded, 0 AS failed, 'failed' AS run_status
UNION ALL SELECT 'first', 0, 1, 'failed' UNION ALL SELECT 'second', 0, 1, 'failed'
""",
)
def run_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived tables in a circle are errors of the run, which still ends and is recorded."""
    store = new_store(spark)
    rows = raw_clients(spark, sf_dir)
    circle = [
        DerivedTable(
            TableSpec(n, (Column("id", "str", key=True),), kind="derived", depends_on=(d,)),
            lambda frames: None,
        )
        for n, d in (("first", "second"), ("second", "first"))
    ]
    source = Source("crm", lambda spark: rows)
    clients = CanonicalTable(CLIENTS, (source,), before_validation=(Transform(clean_clients),))
    result = run_project(
        store, project_id="clients", canonical=[clients], derived=circle, run_id="run-1"
    )
    record = run_records(store.read(RUN_TABLE)).select(F.col("status").alias("run_status"))
    return load_results(spark, result).select(
        "table_name",
        F.col("mode").isNotNull().cast("int").alias("loaded"),
        F.col("error").isNotNull().cast("int").alias("failed"),
    ).join(F.broadcast(record))


@query(
    "two_sources_upsert",
    """
SELECT CAST(id AS BIGINT) AS id, arg_max(name, step) AS name FROM (
  SELECT c_custkey AS id, c_name AS name, 1 AS step FROM customer
  UNION ALL SELECT s_suppkey, s_name, 2 FROM supplier)
GROUP BY id
""",
)
def two_sources_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources that share keys: each is loaded by itself, the later one wins."""
    spec = TableSpec("names", (Column("id", "int", key=True), Column("name")), load_mode="upsert")
    people = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    firms = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    store = new_store(spark)
    sources = (Source("people", lambda spark: people), Source("firms", lambda spark: firms))
    run_project(store, project_id="names", canonical=[CanonicalTable(spec, sources)])
    return store.read("names").select(F.col("id").cast("long").alias("id"), "name")


@query(
    "append_refused_repeats",
    "SELECT CAST(count(*) > count(DISTINCT c_nationkey) AS INT) AS refused, count(*) AS batch_rows FROM customer",
)
def append_refused_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append whose batch repeats a key is refused."""
    spec = TableSpec(
        "nations", (Column("id", "int", key=True), Column("name")), load_mode="append"
    )
    customers = table(spark, sf_dir, "customer")
    batch = customers.select(F.col("c_nationkey").alias("id"), F.col("c_name").alias("name"))
    batch = target_projection(batch, spec)
    try:
        new_store(spark).write(spec, batch)
        refused = 0
    except KeyCollision:
        refused = 1
    return customers.agg(F.lit(refused).alias("refused"), F.count("*").alias("batch_rows"))


def _trimmed(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", F.trim("segment"))


def _marked(df: DataFrame) -> DataFrame:
    return df.withColumn("name", F.concat("name", F.lit(" *")))


@query(
    "stage_chains",
    """
SELECT c_mktsegment AS segment, count(*) AS clients, min(c_name || ' *') AS first_name
FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment
""",
)
def stage_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms after validation, before a build and after it."""
    clients = TableSpec(
        "clients",
        (Column("id", "int", key=True), Column("name"), Column("segment"), Column("balance", "float")),
        load_mode="upsert",
    )
    segments = TableSpec(
        "segments",
        (Column("segment", key=True), Column("clients", "int"), Column("first_name")),
        kind="derived", depends_on=("clients",), load_mode="replace",
    )
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lit(" "), "c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
    )
    store = new_store(spark)
    run_project(
        store,
        project_id="chains",
        canonical=[
            CanonicalTable(
                clients,
                (Source("crm", lambda spark: rows),),
                after_validation=(Transform(_marked),),
            )
        ],
        derived=[
            DerivedTable(
                segments,
                lambda t: t["clients"].filter("balance > 0").groupBy("segment").agg(
                    F.count("*").alias("clients"), F.min("name").alias("first_name")
                ),
                before_build=(Transform(_trimmed),),
            )
        ],
    )
    found = store.read("segments")
    return found.select("segment", F.col("clients").cast("long").alias("clients"), "first_name")


@query(
    "schema_gate",
    """
SELECT 'let in' AS outcome, c_mktsegment AS name, count(*) AS row_count
FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment
UNION ALL
SELECT 'held', column_name, n FROM (VALUES ('balance'), ('id')) g(column_name),
  (SELECT count(*) AS n FROM customer WHERE c_acctbal <= 0) WHERE n > 0
""",
)
def schema_gate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of clients: one is let in, the other lacks columns and is held.

    Rows let in by segment, and for each column that was lacking the rows it held.
    """
    spec = TableSpec(
        "clients",
        (Column("id", "int", key=True), Column("name"), Column("segment"),
         Column("note", nullable=True), Column("balance", "float", nullable=False)),
        load_mode="upsert",
    )
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"),
    )
    sources = (
        Source("in credit", lambda spark: customers.filter("balance > 0")),
        Source("in debt", lambda spark: customers.filter("balance <= 0").drop("id", "balance")),
    )
    store = new_store(spark)
    result = run_project(store, project_id="gate", canonical=[CanonicalTable(spec, sources)])
    held = {(i.column, r.held_rows) for r in result.tables for i in gate_errors(r.issues)}
    let_in = store.read("clients").groupBy(F.col("segment").alias("name")).agg(
        F.count("*").alias("row_count")
    )
    found = spark.createDataFrame(sorted(held), "name string, row_count long").filter("row_count > 0")
    columns = "name", "row_count"
    return let_in.select(F.lit("let in").alias("outcome"), *columns).unionByName(
        found.select(F.lit("held").alias("outcome"), *columns)
    )
