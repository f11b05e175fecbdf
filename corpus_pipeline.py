"""From raw documents to packed training sequences, in five stages.

Each stage takes the documents that the one before kept, all but the last return the
columns of ``documents``: toxic documents go, boilerplate lines go, one document of
each group of near duplicates stays, sources are mixed to target weights, and what is
left is packed into sequences. Stages are written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.bag_minhash import without_near_duplicates
from millrace.llm.catalog.filters import MAX_EPOCHS, MIX_WEIGHTS, mix_levels, without_widespread
from millrace.llm.catalog.tokens import END_ID
from millrace.llm.harmonic_packing import pack_documents
from millrace.llm.mixing import mix_sources
from millrace.llm.toxicity import fit_toxicity, without_toxic
from millrace.scratch import Scratch

def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half for toxicity."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without_toxic(docs, fit_toxicity(docs, labels, scratch=Scratch(spark)))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stand on many sites for their length."""
    cleaned = without_widespread(docs, Scratch(spark))
    text = F.col("cleaned_text")
    changed = F.col("n_removed") > 0
    n_chars = F.when(changed, F.length(text).cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumns({"text": text, "n_chars": n_chars}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return without_near_duplicates(docs, scratch=Scratch(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to the weights of domains, languages and sources; some twice."""
    mixed = mix_sources(
        docs,
        levels=mix_levels(),
        weights=MIX_WEIGHTS,
        scratch=Scratch(spark),
        max_epochs=MAX_EPOCHS,
    )
    return mixed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return pack_documents(
        docs,
        tokenizer=public_tokenizers.path("byte_bpe_50k.json"),
        end_id=END_ID,
        scratch=Scratch(spark),
    )


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

# Neither the fitted model nor the tokenizer has a counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; the result is that of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.stage(stage(spark, docs, sf_dir), name)
    return docs
