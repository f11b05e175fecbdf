"""Queries on duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.bag_minhash import near_duplicates
from millrace.llm.catalog.registry import query, table
from millrace.llm.exact_dedup import exact_duplicates
from millrace.llm.pigeonhole_join import near_vectors
from millrace.scratch import Scratch


@query(
    "op3_exact_dedup",
    """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents
    WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
)
def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays, the largest id."""
    return exact_duplicates(
        table(spark, sf_dir, "documents"), scratch=Scratch(spark), keep="largest"
    )


@query(
    "op7_bag_minhash",
    """
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(
            string_split_regex(lower(coalesce(text, '')), '[ \\t\\n\\r\\v\\f]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    shingles AS (
        SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE
            list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
        FROM words WHERE len(w) > 0
    ),
    counts AS (SELECT doc_id, s, count(*) AS n FROM shingles GROUP BY doc_id, s),
    sizes AS (SELECT doc_id, sum(n) AS n FROM counts GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS n
        FROM counts a JOIN counts b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
    ),
    links AS (
        SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
        WHERE c.n::DOUBLE / (a.n + b.n - c.n)::DOUBLE >= 0.8::DOUBLE
        UNION ALL
        SELECT a.doc_id, b.doc_id FROM words a JOIN words b ON len(a.w) + len(b.w) = 0
    ),
    reached AS (
        SELECT doc_id AS x, doc_id AS y FROM documents
        UNION
        SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
    )
    SELECT x AS doc_id, min(y) AS class_id, x = min(y) AS kept FROM reached GROUP BY x
    """,
)
def bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near duplicates and whether it stays."""
    found = near_duplicates(table(spark, sf_dir, "documents"), scratch=Scratch(spark))
    return found.select("doc_id", "class_id", "kept")


@query(
    "op8_pigeonhole_join",
    """
    WITH RECURSIVE good AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
        WHERE label IS NOT NULL AND list_count(embedding) = len(embedding)
          AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
          AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    links AS (
        SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
           AND list_cosine_similarity(a.v, b.v) >= 0.93
    ),
    reached AS (
        SELECT vec_id AS x, vec_id AS y FROM embeddings
        UNION
        SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x
    ),
    lowest AS (SELECT x, min(y) AS y FROM reached GROUP BY x),
    counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
    SELECT e.vec_id, coalesce(c.n, 0) AS n_links, w.y AS component_id, e.vec_id = w.y AS kept
    FROM embeddings e JOIN lowest w ON e.vec_id = w.x LEFT JOIN counted c ON e.vec_id = c.x
    """,
)
def pigeonhole_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links of cosine 0.93 or more among those of its label."""
    return near_vectors(table(spark, sf_dir, "embeddings"), scratch=Scratch(spark), cosine=0.93)
