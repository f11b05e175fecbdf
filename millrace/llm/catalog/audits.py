"""Queries that audit sources and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.catalog.registry import query, table
from millrace.llm.divergence import source_divergence
from millrace.llm.filter_orders import audit_filters
from millrace.scratch import Scratch

LEAST_DOCUMENTS = 10
LEADING_TERMS = 10


@query(
    "op11_perfect_hash_recount",
    f"""
    WITH rows AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
        FROM documents
    ),
    kept AS (
        SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM rows)
        GROUP BY lang, term HAVING count(*) >= {LEAST_DOCUMENTS}
    ),
    sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM rows),
    found AS (
        SELECT lang, source, term, count(*) AS n
        FROM (SELECT lang, source, unnest(words) AS term FROM rows) JOIN kept USING (lang, term)
        GROUP BY ALL
    ),
    dense AS (
        SELECT lang, source, term, coalesce(n, 0) AS n
        FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)
    ),
    totals AS (SELECT lang, source, sum(n) AS total FROM dense GROUP BY ALL),
    whole AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL),
    whole_totals AS (SELECT lang, sum(n) AS total FROM whole GROUP BY lang),
    p AS (
        SELECT lang, source, term, n,
               1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v)::HUGEINT AS p
        FROM dense JOIN totals USING (lang, source) JOIN sizes USING (lang)
    ),
    q AS (
        SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v)::HUGEINT AS q
        FROM whole JOIN whole_totals USING (lang) JOIN sizes USING (lang)
    ),
    pair_sums AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        GROUP BY ALL
    ),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN pair_sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    ),
    terms AS (
        SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value
        FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
    ),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
    )
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked
    WHERE part = 'pair' OR rank <= {LEADING_TERMS}
    """,
)
def perfect_hash_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source from the others of its language, and its leading terms."""
    return source_divergence(
        table(spark, sf_dir, "documents"),
        scratch=Scratch(spark),
        least_documents=LEAST_DOCUMENTS,
        leading=LEADING_TERMS,
    )


@query(
    "op12_filter_folds",
    """
    WITH rows AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(
                   string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
        FROM documents
    ),
    known AS (
        SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id
    ),
    judged AS (
        SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
               (CASE WHEN len(words) < 50 THEN 1 ELSE 0 END)
               + (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END)
               + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text)
                  THEN 4 ELSE 0 END)
               + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
               + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
        FROM rows LEFT JOIN known USING (doc_id)
    ),
    cells AS (
        SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
        FROM judged GROUP BY part, mask
    ),
    letters(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    orders AS (
        SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order,
               [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
        FROM letters a, letters b, letters c, letters d, letters e
        WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
    ),
    steps AS (
        SELECT filter_order, step, bits[step] AS bit,
               coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
        FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)
    ),
    summed AS (
        SELECT part, filter_order, step, bit,
               sum(CASE WHEN (mask & (before | bit)) = 0 THEN n ELSE 0 END) AS kept,
               sum(CASE WHEN (mask & before) = 0 AND (mask & bit) > 0 THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN (mask & before) > 0 AND (mask & bit) > 0 THEN n ELSE 0 END) AS redundant,
               sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN (mask & before) = 0 AND (mask & bit) > 0 THEN good ELSE 0 END) AS good_lost,
               sum(CASE WHEN (mask & before) = 0 AND (mask & bit) > 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM cells, steps GROUP BY part, filter_order, step, bit
    )
    SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
           redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
           good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
    FROM summed
    """,
)
def filter_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from every source, in all of their 120 orders."""
    return audit_filters(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), scratch=Scratch(spark)
    )
