"""Append, replace and keyed merge as operations on frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lookups import HOT_ROWS, join_lookup
from millrace.scratch import Scratch


def full_key(key: Sequence[str]) -> Column:
    """True where no part of the key is null."""
    present = F.lit(True)
    for name in key:
        present = present & F.col(f"`{name}`").isNotNull()
    return present


def _unmatched(left: DataFrame, right: DataFrame, key: Sequence[str], nullable: bool) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks. A key with a null part matches nothing.

    Where null keys are possible they skip the join: all of them would hash to
    one shuffle partition.
    """
    keys = right.select(*key)
    if not nullable:
        return left.join(keys, list(key), "left_anti").select(*left.columns)
    keyed = left.filter(full_key(key)).join(keys.filter(full_key(key)), list(key), "left_anti")
    return keyed.select(*left.columns).unionByName(left.filter(~full_key(key)))


def merge_rows(
    target: DataFrame, batch: DataFrame, key: Sequence[str], *, nullable_key: bool = False
) -> DataFrame:
    """Keyed upsert: batch rows win, other target rows stay. Without a key, an append.

    Keys are unique on both sides (the duplicate rule sees to that), so neither
    side of the join can be skewed.
    """
    batch = batch.select(*target.columns)
    if not key:
        return target.unionByName(batch)
    return _unmatched(target, batch, key, nullable_key).unionByName(batch)


def merge_buckets(
    target: DataFrame,
    batch: DataFrame,
    key: Sequence[str],
    bucket: str,
    *,
    nullable_key: bool = False,
    n_buckets: int = 1,
    parts: int = 1,
) -> DataFrame:
    """Keyed upsert of rows that carry their storage bucket, in one shuffle.

    Both sides are moved by bucket together, and of each key the batch's row is
    kept. The result is still grouped and sorted by bucket, as the write wants
    it, whereas a join by key would need a second shuffle for that. Keys are
    unique on either side, so buckets are even and no key has over two rows. A
    task gets one of ``parts`` parts of one bucket: by their hashes some buckets
    would share a task, and small shuffles would be put together.
    """
    both = target.withColumn("_newer", F.lit(0)).unionByName(batch.withColumn("_newer", F.lit(1)))
    keyed = both.filter(full_key(key)) if nullable_key else both
    # Buckets come from another hash of the key, so parts of a bucket are even.
    part = F.pmod(F.hash(*[F.col(f"`{c}`") for c in key]), F.lit(parts))
    task = (F.col(f"`{bucket}`") * parts + part).cast("int")
    order = Window.partitionBy(bucket, "_task", *key).orderBy(F.desc("_newer"))
    merged = (
        keyed.withColumn("_task", task)
        .repartitionById(n_buckets * parts, "_task")
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") == 1)
        .drop("_place", "_newer", "_task")
    )
    if not nullable_key:
        return merged
    # Rows without a full key match nothing. There may be very many of them in
    # one bucket, so Spark sizes their tasks by what it finds.
    loose = both.filter(~full_key(key)).drop("_newer").hint("rebalance", bucket)
    return merged.unionByName(loose)


def insert_absent(
    target: DataFrame, batch: DataFrame, key: Sequence[str], *, nullable_key: bool = False
) -> DataFrame:
    """Keyed insert that keeps stored rows and adds only keys not stored yet."""
    batch = batch.select(*target.columns)
    return target.unionByName(_unmatched(batch, target, key, nullable_key))


def key_collisions(target: DataFrame, batch: DataFrame, key: Sequence[str]) -> DataFrame:
    """Batch keys that the target already holds."""
    return batch.select(*key).join(target.select(*key), list(key), "left_semi")


def merge_counts(
    target: DataFrame, batch: DataFrame, key: Sequence[str], *, hash_column: str | None = None
) -> DataFrame:
    """One row: inserted, updated (keys already stored) and changed (content differs too)."""
    stored = target.select(
        *key,
        F.lit(True).alias("_stored"),
        (F.col(hash_column) if hash_column else F.lit(None).cast("string")).alias("_stored_hash"),
    )
    both = batch.select(*key, *([hash_column] if hash_column else [])).join(
        stored, list(key), "left"
    )
    counts = [
        F.count_if(F.col("_stored").isNull()).alias("inserted_rows"),
        F.count_if(F.col("_stored").isNotNull()).alias("updated_rows"),
    ]
    if hash_column:
        differs = F.col("_stored") & ~F.col(hash_column).eqNullSafe(F.col("_stored_hash"))
        counts.append(F.count_if(differs).alias("changed_rows"))
    return both.agg(*counts)


def changed_rows(
    target: DataFrame, batch: DataFrame, key: Sequence[str], *, hash_column: str = "_record_hash"
) -> DataFrame:
    """Batch rows that are new or whose record hash differs from the stored one."""
    stored = target.select(*key, F.col(hash_column).alias("_stored_hash"))
    return (
        batch.join(stored, list(key), "left")
        .filter(~F.col(hash_column).eqNullSafe(F.col("_stored_hash")))
        .select(*batch.columns)
    )


def orphan_keys(
    child: DataFrame, parent: DataFrame, child_key: Sequence[str], parent_key: Sequence[str]
) -> DataFrame:
    """Foreign keys without a parent and their row counts.

    The child is reduced to one row per foreign key before the join, so a key
    held by a large part of the rows costs no more than any other.
    """
    parents = parent.select(*[F.col(p).alias(c) for c, p in zip(child_key, parent_key, strict=True)])
    return (
        child.filter(full_key(child_key))
        .groupBy(*child_key)
        .agg(F.count("*").alias("child_rows"))
        .join(parents, list(child_key), "left_anti")
    )


def orphan_rows(
    child: DataFrame,
    parent: DataFrame,
    child_key: Sequence[str],
    parent_key: Sequence[str],
    *,
    scratch: Scratch,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Whole child rows without a parent."""
    orphans = orphan_keys(child, parent, child_key, parent_key)
    staged = scratch.stage(orphans, "orphan-keys")
    hot = staged.filter(F.col("child_rows") >= hot_rows).select(*child_key)
    return join_lookup(
        child, staged.select(*child_key), child_key, scratch=scratch, how="left_semi", hot=hot
    )
