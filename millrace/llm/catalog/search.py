"""Queries that search vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.catalog.registry import query, table
from millrace.llm.multiprobe import nearest_neighbours
from millrace.scratch import Scratch

NEAREST = 20


@query("op13_multiprobe")
def multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every twentieth one, by inner product."""
    vectors = table(spark, sf_dir, "embeddings")
    asks = F.col("vec_id") % 20 == 0
    return nearest_neighbours(vectors, asks, NEAREST, scratch=Scratch(spark))
