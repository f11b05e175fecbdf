"""Exact duplicates: group by a 128-bit content hash, then compare bytes.

Only hashes travel for the grouping. Texts are looked at a second time for groups of
two or more, each against one representative of its hash, in a join whose hot keys
adaptive execution can split. Should a hash hold different texts, its rows are
grouped again by the texts themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import named, text_of
from millrace.scratch import Scratch


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _group(rows: DataFrame, on: list[str], keep: str, scratch: Scratch) -> DataFrame:
    """Every row with the row that stays of those equal in ``on``."""
    if keep == "largest":
        best = F.max(F.struct("doc_id", (-F.col("row")).alias("row")))
        best_row = -F.col("best.row")
    else:
        best = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row"))
        best_row = F.col("best.row")
    groups = rows.groupBy(*on).agg(F.count("*").alias("size"), best.alias("best"))
    several = groups.filter("size > 1").select(
        *on, "size", F.col("best.doc_id").alias("best_id"), best_row.alias("best_row")
    )
    several = scratch.stage(several, "repeated-texts")
    joined = rows.join(several, on, "left")
    alone = F.col("size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def exact_duplicates(
    docs: DataFrame,
    *,
    scratch: Scratch,
    id_column: str = "doc_id",
    text_column: str = "text",
    keep: str = "smallest",
    hash_of: Callable[[Column], Column] = content_hash,
) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.

    Texts are equal when their bytes are; a null text is an empty one, and empty texts
    equal each other. ``keep`` names the id that stays, ``smallest`` or ``largest``;
    a null id stays only where there is no other. Of rows that also share that id one
    stays: the first as read. An empty table gives an empty result; other columns are
    ignored.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'.")
    texts = docs.select(named(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    texts = texts.withColumn("hash", hash_of(F.col("text")))
    numbered = F.monotonically_increasing_id().alias("row")
    sha = F.unhex(F.sha2("text", 256)).alias("sha256")
    hashed = scratch.stage(texts.select(numbered, "doc_id", "hash", sha), "text-hashes")

    counted = hashed.groupBy("hash").agg(
        F.count("*").alias("size"), F.max("doc_id").alias("best_id")
    )
    several = scratch.stage(counted.filter("size > 1").select("hash", "best_id"), "several")
    # A sort-merge join at every size: adaptive execution splits its hot hashes.
    copies = scratch.stage(texts.join(several.hint("merge"), "hash"), "copies")
    chosen = copies.filter(F.col("doc_id").eqNullSafe(F.col("best_id")))
    chosen = scratch.stage(chosen.groupBy("hash").agg(F.min("text").alias("one_text")), "chosen")
    unlike = copies.join(chosen, "hash").filter(F.col("text") != F.col("one_text"))
    unlike = scratch.stage(unlike.select("hash"), "unlike")
    if unlike.isEmpty():
        return _group(hashed, ["hash"], keep, scratch)

    colliding = scratch.stage(unlike.distinct(), "colliding")
    alike = hashed.join(colliding, "hash", "left_anti")
    rest = scratch.stage(
        texts.join(colliding, "hash", "left_semi").select(numbered, "doc_id", "text", sha), "rest"
    )
    return _group(alike, ["hash"], keep, scratch).unionByName(
        _group(rest, ["text"], keep, scratch)
    )
