"""Queries on documents, chunks, the chunk index and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.documents import chunk_documents, chunk_totals, project_documents
from millrace.operators.index import (
    cascade_vectors,
    get_chunk,
    index_rows,
    merge_index,
    nearest_vectors,
    obsolete_chunks,
    query_chunks,
    sync_index,
    vector_sources,
)
from millrace.plans.catalog.registry import query, table
from millrace.scratch import Scratch
from millrace.sources.tables import TableStore
from millrace.spec import DocumentSpec

CUSTOMER_DOCUMENTS = DocumentSpec(
    "customer_semantics",
    "customers",
    "{c_name} trades in {c_mktsegment} from {n_name}{no_such_field}. Balance {c_acctbal}, rating {rating}. {{fixed}}",
    title_template="Customer: {c_name}",
    source_pk="c_custkey",
    metadata_fields=("c_custkey", "c_mktsegment", "rating", "absent"),
    tag_fields=("c_mktsegment", "rating", "n_name"),
    extra_metadata={"origin": "crm", "rating": 7},
)

CUSTOMERS_SQL = """
WITH rows_ AS (
  SELECT *, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS rating
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def customers_with_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    rating = F.when(F.col("c_acctbal") > 0, F.col("c_nationkey"))
    return (
        table(spark, sf_dir, "customer").join(nations, "c_nationkey").withColumn("rating", rating)
    )


@query(
    "document_projection",
    CUSTOMERS_SQL
    + """
SELECT CAST(c_custkey AS VARCHAR) AS source_pk, 'customers' AS source_table,
       'customer_semantics' AS semantic_id, 'Customer: ' || c_name AS title,
       c_name || ' trades in ' || c_mktsegment || ' from ' || n_name || '. Balance ' ||
         CAST(c_acctbal AS VARCHAR) || ', rating ' || coalesce(CAST(rating AS VARCHAR), 'None') ||
         '. {fixed}' AS body
FROM rows_
""",
)
def document_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = project_documents(customers_with_nation(spark, sf_dir), CUSTOMER_DOCUMENTS)
    return documents.select("source_pk", "source_table", "semantic_id", "title", "body")


@query(
    "document_metadata",
    CUSTOMERS_SQL
    + """
SELECT CAST(c_custkey AS VARCHAR) AS source_pk,
       '{"c_custkey":' || CAST(c_custkey AS VARCHAR) || ',"c_mktsegment":"' || c_mktsegment
         || '","rating":7,"absent":null,"origin":"crm"}' AS metadata
FROM rows_
""",
)
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = project_documents(customers_with_nation(spark, sf_dir), CUSTOMER_DOCUMENTS)
    return documents.select("source_pk", "metadata")


@query(
    "document_tags",
    CUSTOMERS_SQL
    + """
SELECT CAST(c_custkey AS VARCHAR) AS source_pk,
       concat_ws('|', c_mktsegment, CAST(rating AS VARCHAR), n_name) AS tags
FROM rows_
""",
)
def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = project_documents(customers_with_nation(spark, sf_dir), CUSTOMER_DOCUMENTS)
    return documents.select("source_pk", F.array_join("tags", "|").alias("tags"))


@query(
    "document_formats",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS source_pk,
       'No. ' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') || ': ' || printf('%.2f', o_totalprice)
         || ' ''' || o_orderpriority || '''' AS body
FROM orders WHERE o_orderstatus <> 'P'
""",
)
def document_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format specs and conversions; rows without a price cannot be formatted and fail."""
    documents, _ = priced_orders(spark, sf_dir)
    return documents.select("source_pk", "body")


@query(
    "document_failures",
    """
SELECT reason, count(*) AS row_count
FROM (SELECT 'unsupported format string passed to NoneType.__format__' AS reason FROM orders WHERE o_orderstatus = 'P'
      UNION ALL SELECT 'Unsupported document_id_strategy: by_guess' FROM customer)
GROUP BY reason
""",
)
def document_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, unpriced = priced_orders(spark, sf_dir)
    by_guess = DocumentSpec("guess", "customers", "{c_name}", id_strategy="by_guess")
    _, unnamed = project_documents(table(spark, sf_dir, "customer"), by_guess)
    return (
        unpriced.unionByName(unnamed).groupBy("reason").agg(F.count("*").alias("row_count"))
    )


def priced_orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spec = DocumentSpec(
        "priced",
        "orders",
        "No. {o_orderkey:08d}: {o_totalprice:.2f} {o_orderpriority!r}",
        source_pk="o_orderkey",
    )
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return project_documents(table(spark, sf_dir, "orders").withColumn("o_totalprice", price), spec)


@query(
    "document_id_hash",
    """
SELECT CAST(p_partkey AS VARCHAR) AS source_pk,
       substr(sha256('parts::' || CAST(to_json({'p_brand': p_brand, 'p_name': p_name, 'p_partkey': p_partkey,
         'p_retailprice': p_retailprice, 'p_size': nullif(p_size, 1), 'p_type': p_type}) AS VARCHAR)), 1, 32) AS doc_id
FROM part
""",
)
def document_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").withColumn("p_size", F.nullif("p_size", F.lit(1)))
    spec = DocumentSpec("parts", "parts", "{p_name}", source_pk="p_partkey")
    documents, _ = project_documents(parts, spec)
    return documents.select("source_pk", "doc_id")


@query(
    "document_id_row_index",
    """
SELECT CAST(o_orderkey AS VARCHAR) AS source_pk,
       'orders_' || CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS VARCHAR) AS doc_id,
       row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS source_row_index
FROM orders
""",
)
def document_id_row_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("dearest_first", -F.col("o_totalprice"))
    spec = DocumentSpec(
        "orders",
        "orders",
        "{o_orderkey}",
        source_pk="o_orderkey",
        id_strategy="row_index",
        order_by=("dearest_first", "o_orderkey"),
    )
    documents, _ = project_documents(orders, spec, scratch=Scratch(spark))
    return documents.select("source_pk", "doc_id", "source_row_index")


def text_documents(spark: SparkSession, sf_dir: str, revised: bool = False) -> DataFrame:
    """The documents table in document layout. Revised: English texts end differently,
    and documents without a label are gone."""
    texts = table(spark, sf_dir, "documents")
    body = F.col("text")
    if revised:
        texts = texts.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
        body = F.when(F.col("lang") == "en", F.concat("text", F.lit(" [revised]"))).otherwise(body)
    return texts.select(
        F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"),
        F.lit("documents").alias("source_table"),
        F.col("doc_id").cast("string").alias("source_pk"),
        F.lit("document_semantics").alias("semantic_id"),
        F.concat(F.lit("Document "), F.col("doc_id")).alias("title"),
        body.alias("body"),
        F.to_json(F.struct("lang", "source")).alias("metadata"),
        F.array("lang").alias("tags"),
    )


def turn_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat_ws("_", F.lit("c"), "conv_id", "turn").alias("doc_id"),
        F.lit("conversations").alias("source_table"),
        F.col("conv_id").cast("string").alias("source_pk"),
        F.lit("turn_semantics").alias("semantic_id"),
        F.lit(None).cast("string").alias("title"),
        F.col("text").alias("body"),
        F.lit("{}").alias("metadata"),
        F.array("role").alias("tags"),
    )


CHUNKS_SQL = """
WITH docs AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS doc_id, 'document_semantics' AS semantic_id, text AS body,
         doc_id IN (SELECT doc_id FROM labels) AS stays, lang FROM documents),
turns AS (
  SELECT 'c_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS doc_id,
         'turn_semantics' AS semantic_id, text AS body FROM conversations),
revised AS (
  SELECT doc_id, semantic_id, CASE WHEN lang = 'en' THEN body || ' [revised]' ELSE body END AS body
  FROM docs WHERE stays),
old_chunks AS (
  SELECT doc_id, semantic_id, p // 450 AS chunk_index, substr(body, p + 1, 500) AS chunk_text, 'run-1' AS run_id
  FROM (SELECT *, unnest(generate_series(CAST(0 AS BIGINT), greatest(length(body) - 1, 0), 450)) AS p
        FROM (SELECT doc_id, semantic_id, body FROM docs UNION ALL SELECT * FROM turns))),
new_chunks AS (
  SELECT doc_id, semantic_id, p // 450 AS chunk_index, substr(body, p + 1, 500) AS chunk_text, 'run-2' AS run_id
  FROM (SELECT *, unnest(generate_series(CAST(0 AS BIGINT), greatest(length(body) - 1, 0), 450)) AS p FROM revised)),
old AS (SELECT doc_id || '_' || CAST(chunk_index AS VARCHAR) AS chunk_id, * FROM old_chunks),
new AS (SELECT doc_id || '_' || CAST(chunk_index AS VARCHAR) AS chunk_id, * FROM new_chunks)
"""
INDEX_RESULT = "semantic_id, chunk_id, chunk_text, run_id"


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = text_documents(spark, sf_dir).unionByName(turn_documents(spark, sf_dir))
    return index_rows(chunk_documents(both, size=500, overlap=50), "run-1")


def revised_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    revised = text_documents(spark, sf_dir, revised=True)
    return index_rows(chunk_documents(revised, size=500, overlap=50), "run-2")


def short(index: DataFrame) -> DataFrame:
    return index.select("semantic_id", "chunk_id", "chunk_text", "run_id")


@query(
    "chunk_documents",
    """
SELECT 'd' || CAST(doc_id AS VARCHAR) AS doc_id, 'd' || CAST(doc_id AS VARCHAR) || '_' || CAST(p // 450 AS VARCHAR) AS chunk_id,
       CAST(p // 450 AS INTEGER) AS chunk_index, substr(text, p + 1, 500) AS chunk_text,
       CAST(length(substr(text, p + 1, 500)) AS INTEGER) AS char_count
FROM (SELECT *, unnest(generate_series(CAST(0 AS BIGINT), greatest(length(text) - 1, 0), 450)) AS p FROM documents)
""",
)
def chunk_documents_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_documents(text_documents(spark, sf_dir), size=500, overlap=50)
    return chunks.select("doc_id", "chunk_id", "chunk_index", "chunk_text", "char_count")


@query(
    "chunk_counts",
    """
SELECT semantic_id, count(DISTINCT doc_id) AS total_documents, count(*) AS total_chunks,
       CAST(sum(length(substr(body, p + 1, 1000))) AS BIGINT) AS total_chars
FROM (SELECT *, unnest(generate_series(CAST(0 AS BIGINT), greatest(length(body) - 1, 0), 900)) AS p
      FROM (SELECT 'document_semantics' AS semantic_id, 'd' || CAST(doc_id AS VARCHAR) AS doc_id, text AS body FROM documents
            UNION ALL SELECT 'turn_semantics', 'c_' || CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR), text
            FROM conversations))
GROUP BY semantic_id
""",
)
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = text_documents(spark, sf_dir).unionByName(turn_documents(spark, sf_dir))
    return chunk_totals(both, chunk_documents(both))


@query(
    "index_merge_replace",
    CHUNKS_SQL
    + f"SELECT {INDEX_RESULT} FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM new) UNION ALL SELECT {INDEX_RESULT} FROM new",
)
def index_merge_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return short(merge_index(stored_index(spark, sf_dir), revised_index(spark, sf_dir)))


@query(
    "index_merge_keep",
    CHUNKS_SQL
    + f"SELECT {INDEX_RESULT} FROM old UNION ALL SELECT {INDEX_RESULT} FROM new WHERE chunk_id NOT IN (SELECT chunk_id FROM old)",
)
def index_merge_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = stored_index(spark, sf_dir), revised_index(spark, sf_dir)
    return short(merge_index(stored, new, replace_existing=False))


@query(
    "index_delta_sync",
    CHUNKS_SQL
    + f"SELECT {INDEX_RESULT} FROM old WHERE semantic_id <> 'document_semantics' UNION ALL SELECT {INDEX_RESULT} FROM new",
)
def index_delta_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = stored_index(spark, sf_dir), revised_index(spark, sf_dir)
    return short(sync_index(stored, new, "document_semantics"))


@query(
    "index_delta_sync_keep",
    CHUNKS_SQL
    + f"""
SELECT {INDEX_RESULT} FROM old
WHERE semantic_id <> 'document_semantics' OR chunk_id IN (SELECT chunk_id FROM new)
UNION ALL SELECT {INDEX_RESULT} FROM new WHERE chunk_id NOT IN (SELECT chunk_id FROM old)
""",
)
def index_delta_sync_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = stored_index(spark, sf_dir), revised_index(spark, sf_dir)
    return short(sync_index(stored, new, "document_semantics", replace_existing=False))


@query(
    "index_obsolete",
    CHUNKS_SQL
    + "SELECT chunk_id FROM old WHERE semantic_id = 'document_semantics' AND chunk_id NOT IN (SELECT chunk_id FROM new)",
)
def index_obsolete(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, new = stored_index(spark, sf_dir), revised_index(spark, sf_dir)
    return obsolete_chunks(stored, new, "document_semantics").select("chunk_id")


@query(
    "index_query",
    CHUNKS_SQL
    + """
SELECT chunk_id, chunk_index, chunk_text FROM old
WHERE semantic_id = 'turn_semantics' AND run_id = 'run-1'
ORDER BY semantic_id, doc_id, chunk_index LIMIT 100
""",
)
def index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = query_chunks(
        stored_index(spark, sf_dir),
        semantic_id="turn_semantics",
        source_table="conversations",
        run_id="run-1",
    )
    return found.select("chunk_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_text")


@query("index_lookup", CHUNKS_SQL + "SELECT chunk_id, chunk_text FROM old WHERE chunk_id = 'd7_0'")
def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return get_chunk(stored_index(spark, sf_dir), "d7_0").select("chunk_id", "chunk_text")


@query(
    "index_stored_sync",
    CHUNKS_SQL
    + f"SELECT {INDEX_RESULT} FROM old WHERE semantic_id <> 'document_semantics' UNION ALL SELECT {INDEX_RESULT} FROM new",
)
def index_stored_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delta sync on a stored index: one partition is written, others are not touched."""
    store = index_store(spark, sf_dir)
    new = revised_index(spark, sf_dir)
    store.replace_partition("chunks", new, "semantic_id", "document_semantics")
    return short(store.read("chunks"))


def index_store(spark: SparkSession, sf_dir: str) -> TableStore:
    store = TableStore(spark, Scratch(spark).path("index"))
    store.append_rows("chunks", stored_index(spark, sf_dir), "semantic_id")
    return store


@query(
    "index_delete",
    CHUNKS_SQL + f"SELECT {INDEX_RESULT} FROM old WHERE semantic_id <> 'document_semantics'",
)
def index_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = index_store(spark, sf_dir)
    store.drop_partition("chunks", "document_semantics")
    return short(store.read("chunks"))


def first_chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as that of the first chunk of the document with its id."""
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("d"), F.col("vec_id"), F.lit("_0")).alias("chunk_id"), "vec_id", "embedding"
    )


@query(
    "vector_source_join",
    """
SELECT v.vec_id, v.label AS source_row_id, n.n_name
FROM embeddings v JOIN nation n ON v.label = n.n_nationkey
""",
)
def vector_source_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "source_row_id")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = vector_sources(vectors, nations, source_id="n_nationkey", scratch=Scratch(spark))
    return joined.select("vec_id", "source_row_id", "n_name")


@query(
    "vector_document_join",
    "SELECT v.vec_id, d.lang, d.text FROM embeddings v JOIN documents d ON v.vec_id = d.doc_id",
)
def vector_document_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("source_row_id", F.col("vec_id"))
    texts = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    joined = vector_sources(vectors, texts, source_id="doc_id", scratch=Scratch(spark))
    return joined.select("vec_id", "lang", "text")


@query(
    "vector_cascade_delete",
    "SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) AND vec_id IN (SELECT doc_id FROM labels)",
)
def vector_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the sync, vectors of the chunks that went are gone as well."""
    left = sync_index(
        stored_index(spark, sf_dir), revised_index(spark, sf_dir), "document_semantics"
    )
    return cascade_vectors(first_chunk_vectors(spark, sf_dir), left).select("vec_id")


@query(
    "vector_knn_exact",
    """
WITH centres AS (
  SELECT label AS query_id, list(m ORDER BY i) AS centre
  FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
        FROM embeddings, range(1, 65) r(i) GROUP BY label, i)
  GROUP BY label),
scored AS (
  SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id
           ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre) DESC, vec_id) AS rank
  FROM embeddings, centres)
SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM scored WHERE rank <= 5
""",
)
def vector_knn_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to the centre of each label."""
    vectors = table(spark, sf_dir, "embeddings")
    found = nearest_vectors(vectors, label_centres(vectors), 5, scratch=Scratch(spark))
    return found.select("query_id", "vec_id", "rank")


def label_centres(vectors: DataFrame) -> DataFrame:
    """Mean vector of each label: the stated query set, one row per label."""
    width = vectors.agg(F.max(F.size("embedding"))).first()[0]
    means = [F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(width)]
    query_id = F.col("label").cast("long").alias("query_id")
    return vectors.groupBy(query_id).agg(F.array(*means).alias("embedding"))


@query(
    "vector_knn_blocks",
    """
WITH scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, row_number() OVER (PARTITION BY a.vec_id
           ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank
  FROM embeddings a, embeddings b WHERE a.vec_id % 10 = 0)
SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM scored WHERE rank <= 3
""",
)
def vector_knn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors of every tenth one; queries in blocks meet the vectors in parts."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = nearest_vectors(
        vectors, queries, 3, scratch=Scratch(spark), resident_floats=0, block_queries=64
    )
    return found.select("query_id", "vec_id", "rank")


@query(
    "vector_knn_chunks",
    """
WITH centres AS (
  SELECT label AS query_id, list(m ORDER BY i) AS centre
  FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m
        FROM embeddings, range(1, 65) r(i) GROUP BY label, i)
  GROUP BY label),
scored AS (
  SELECT query_id, 'chunk-' || vec_id AS chunk_id, row_number() OVER (PARTITION BY query_id
           ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), centre) DESC, 'chunk-' || vec_id) AS rank
  FROM embeddings, centres WHERE label <> 0)
SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM scored WHERE rank <= 3
""",
)
def vector_knn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors by text id; vectors with a value that is no number are left out."""
    vectors = table(spark, sf_dir, "embeddings")
    broken = F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))
    chunks = vectors.select(
        F.concat(F.lit("chunk-"), "vec_id").alias("chunk_id"),
        F.when(F.col("label") == 0, broken).otherwise(F.col("embedding")).alias("embedding"),
    )
    nearest = nearest_vectors(
        chunks, label_centres(vectors), 3, scratch=Scratch(spark), id_column="chunk_id"
    )
    return nearest.select("query_id", "chunk_id", "rank")
