"""Queries that judge, clean and choose documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import backoff_automaton as backoff
from millrace.llm.catalog.registry import query, table
from millrace.llm.line_spread import CHANCE_WORDS, LONG_WORDS, SLACK, without_boilerplate
from millrace.llm.mixing import mix_sources
from millrace.llm.toxicity import fit_toxicity, held_out, score_texts
from millrace.scratch import Scratch


@query("op1_factorization_machine")
def factorization_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the labels is never learned from."""
    docs = table(spark, sf_dir, "documents")
    machine = fit_toxicity(docs, table(spark, sf_dir, "labels"), scratch=Scratch(spark))
    return score_texts(docs, machine).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


# Sites that make a line boilerplate, and those that do for one of 50 words or more.
MIN_SITES = 8
LONG_SITES = 3

# Two texts that share a part f of each have a Jaccard similarity of f / (2 - f), which
# is the 0.8 of near duplicates from here on. Below, no document dedup takes anything.
COPY_SHARE = 8 / 9


@query(
    "op5_line_spread",
    f"""
    WITH rows AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    texts AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS parts FROM rows),
    places AS (
        SELECT doc_id, text, unnest(parts) AS line, unnest(range(len(parts))) AS place FROM texts
    ),
    lines AS (
        SELECT doc_id, text, place, trim(line, ' ') AS line, line AS raw FROM places
    ),
    seen AS (
        SELECT line, len(string_split_regex(line, ' +')) AS n_words, count(*) AS n,
               count(DISTINCT source) AS sites
        FROM (
            SELECT source, trim(line, ' ') AS line
            FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM rows)
        ) WHERE line <> '' GROUP BY line
    ),
    alike AS (SELECT n_words, sum(n)::DOUBLE AS alike FROM seen GROUP BY n_words),
    spread AS (
        SELECT * FROM seen
        WHERE sites >= CASE WHEN n_words >= {LONG_WORDS} THEN {LONG_SITES} ELSE {MIN_SITES} END
    ),
    words AS (
        SELECT word, count(*) AS times FROM (
            SELECT unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS word FROM rows
        ) WHERE word <> '' GROUP BY word
    ),
    short_words AS (
        SELECT line, n, word, count(*) AS k FROM (
            SELECT line, n, unnest(string_split_regex(lower(line), '[^\\p{{L}}\\p{{N}}]+')) AS word
            FROM spread WHERE n_words <= {CHANCE_WORDS}
        ) WHERE word <> '' GROUP BY line, n, word
    ),
    likely AS (
        SELECT line, sum(k) AS k, bool_or(times <= n * k) AS own_words,
               sum(CASE WHEN times > n * k THEN k * (ln(times - n * k) + ln({SLACK})) END) AS logs
        FROM short_words JOIN words USING (word) GROUP BY line
    ),
    boilerplate AS (
        SELECT line FROM spread JOIN alike USING (n_words) LEFT JOIN likely USING (line)
        WHERE n_words > {CHANCE_WORDS} OR k IS NULL OR own_words
           OR n > (alike - n) * exp(
               logs - k * ln(greatest((SELECT sum(times) FROM words) - n * k, 1)))
    ),
    marked AS (
        SELECT l.*, l.line <> '' AS counted, s.line IS NOT NULL AS wide
        FROM lines l LEFT JOIN boilerplate s ON l.line = s.line
    ),
    sizes AS (
        SELECT doc_id, text, count(*) FILTER (counted) AS n_lines, count(*) FILTER (wide) AS n_wide,
               coalesce(sum(length(line)) FILTER (wide), 0)
                   <= 8::DOUBLE / 9 * coalesce(sum(length(line)) FILTER (counted), 0) AS cut,
               coalesce(string_agg(raw, chr(10) ORDER BY place) FILTER (NOT wide), '') AS rest
        FROM marked GROUP BY doc_id, text
    )
    SELECT r.doc_id,
           CASE WHEN s.cut AND s.n_wide > 0 THEN s.rest ELSE r.text END AS cleaned_text,
           s.n_lines, CASE WHEN s.cut THEN s.n_wide ELSE 0 END AS n_removed
    FROM rows r JOIN sizes s ON r.doc_id = s.doc_id AND r.text = s.text
    """,
)
def line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that stand on many sites for their length."""
    cleaned = without_widespread(table(spark, sf_dir, "documents"), Scratch(spark))
    return cleaned.select("doc_id", "cleaned_text", "n_lines", "n_removed")


def without_widespread(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``without_boilerplate`` with the parameters of the query and the pipeline."""
    return without_boilerplate(
        docs,
        scratch=scratch,
        min_sites=MIN_SITES,
        max_share=COPY_SHARE,
        long_sites=LONG_SITES,
        by_chance=True,
    )


MIX_WEIGHTS = {
    "domain": {"web": 5, "reference": 3, "forum": 2},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
    "source": {"src0": 8},
}
MAX_EPOCHS = 2


def mix_levels() -> dict:
    """Domain, language and source of a document; the domain follows from the source."""
    source = F.coalesce("source", F.lit(""))
    domain = F.when(source.rlike("^src[0-9]$"), "web").when(
        source.rlike("^src1[0-4]$"), "reference"
    )
    return {"domain": domain.otherwise("forum"), "lang": F.col("lang"), "source": F.col("source")}


def _level_sql(level: str, above: list[str], parents: str) -> str:
    """One step of the budgets from parents to children, as in ``leaf_budgets``."""
    cases = " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items())
    path = ", ".join([*above, level])
    join = f"JOIN {parents} USING ({', '.join(above)})" if above else f"CROSS JOIN {parents}"
    siblings = f"PARTITION BY {', '.join(above)}" if above else ""
    order = f"{siblings} ORDER BY capacity::DOUBLE / weight::DOUBLE, {level}"
    order += " ROWS UNBOUNDED PRECEDING"
    return f"""
    SELECT {path}, least(capacity, CASE WHEN filled THEN capacity ELSE
        (weight::HUGEINT * (given - c_full)) // (w_all - w_full) END)::BIGINT AS given
    FROM (
        SELECT *, sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER ({siblings}) AS c_full,
               sum(CASE WHEN filled THEN weight ELSE 0 END) OVER ({siblings}) AS w_full
        FROM (
            SELECT *, c_sum::HUGEINT * weight + capacity::HUGEINT * (w_all - w_sum)
                   <= given::HUGEINT * weight AS filled
            FROM (
                SELECT *, sum(capacity) OVER ({order}) AS c_sum, sum(weight) OVER ({order}) AS w_sum,
                       sum(weight) OVER ({siblings}) AS w_all
                FROM (
                    SELECT {path}, sum(tokens * {MAX_EPOCHS})::BIGINT AS capacity,
                           CASE {cases} ELSE 1 END AS weight
                    FROM leaves GROUP BY {path}
                ) {join}
            )
        )
    )"""


@query(
    "op4_hierarchical_mixing",
    f"""
    WITH rows AS (
        SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '^src[0-9]$') THEN 'web'
                    WHEN regexp_matches(coalesce(source, ''), '^src1[0-4]$') THEN 'reference'
                    ELSE 'forum' END AS domain,
               coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS tokens
        FROM documents
    ),
    leaves AS (
        SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL
    ),
    root AS (SELECT sum(tokens)::BIGINT AS given FROM leaves),
    level1 AS ({_level_sql("domain", [], "root")}),
    level2 AS ({_level_sql("lang", ["domain"], "level1")}),
    level3 AS ({_level_sql("source", ["domain", "lang"], "level2")}),
    plan AS (
        SELECT domain, lang, source,
               CASE WHEN tokens = 0 THEN 1 ELSE given // greatest(tokens, 1) END AS epochs,
               CASE WHEN tokens = 0 THEN 0 ELSE given % greatest(tokens, 1) END AS rest
        FROM leaves JOIN level3 USING (domain, lang, source)
    ),
    reached AS (
        SELECT *, rest > 0 AND sum(tokens) OVER (
            PARTITION BY domain, lang, source
            ORDER BY md5(concat_ws('|', 'mix', epochs + 1, doc_id))) <= rest AS more
        FROM rows JOIN plan USING (domain, lang, source)
    )
    SELECT doc_id, domain, lang, source, tokens,
           unnest(range(1, epochs + 1 + CASE WHEN more THEN 1 ELSE 0 END)) AS epoch
    FROM reached
    """,
)
def hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by epoch, mixed to weights of domains, languages and sources."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix_sources(
        docs,
        levels=mix_levels(),
        weights=MIX_WEIGHTS,
        scratch=Scratch(spark),
        max_epochs=MAX_EPOCHS,
    )
    return mixed.select(
        F.col("row.c0").alias("doc_id"), "domain", "lang", "source", "tokens", "epoch"
    )


@query("op9_backoff_automaton")
def backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document; a seventh of them is never learned from."""
    docs = table(spark, sf_dir, "documents")
    held = backoff.held_out(F.col("doc_id"))
    scores = backoff.score_texts(docs, ~held, scratch=Scratch(spark))
    return scores.select("doc_id", held.alias("held_out"), *scores.columns[1:])
