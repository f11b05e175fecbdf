"""Joins against a table that has at most one row per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import Scratch

# A key is hot from this many rows on. N rows have at most N / HOT_ROWS hot keys,
# so a table of hot keys stays small: a million of them takes 1e12 rows.
HOT_ROWS = 1_000_000


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a frame; exact file sizes for written tables."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    """The session's broadcast threshold in bytes, 0 when broadcasting is off."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return max(int(limit), 0)


def hot_keys(
    rows: DataFrame, on: Sequence[str], scratch: Scratch, *, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Keys with at least ``hot_rows`` rows; counts are combined before the shuffle."""
    counted = rows.groupBy(*on).agg(F.count("*").alias("_rows"))
    return scratch.stage(counted.filter(F.col("_rows") >= hot_rows).select(*on), "hot-keys")


def _joined(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], how: str, null_safe: bool
) -> DataFrame:
    lookup = lookup.select(
        *[F.col(f"`{c}`").alias(f"_on_{c}") if c in on else F.col(f"`{c}`") for c in lookup.columns]
    )
    pairs = [
        (
            F.col(f"`{c}`").eqNullSafe(F.col(f"`_on_{c}`"))
            if null_safe
            else F.col(f"`{c}`") == F.col(f"`_on_{c}`")
        )
        for c in on
    ]
    joined = rows.join(lookup, reduce(lambda a, b: a & b, pairs), how)
    return joined.drop(*[f"_on_{c}" for c in on])


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    *,
    scratch: Scratch,
    how: str = "left",
    null_safe: bool = False,
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join rows to a lookup with unique keys, whatever the distribution of the keys.

    A lookup below the broadcast threshold is an ordinary join that Spark broadcasts.
    Above it, rows of hot keys are told apart by the list of these keys (at most
    rows / hot_rows of them), get a salt and meet lookup rows repeated for every salt,
    so that a hot key is spread over as many tasks as there are shuffle partitions.
    The remaining keys, none of which has more than ``hot_rows`` rows, are shuffled.
    ``how`` is left, inner, left_semi or left_anti.
    """
    if planned_bytes(lookup) <= broadcast_limit(lookup):
        return _joined(rows, lookup, on, how, null_safe)
    if hot is None:
        hot = hot_keys(rows, on, scratch, hot_rows=hot_rows)
    if hot.isEmpty():
        return _joined(rows, lookup, on, how, null_safe)
    keys = F.broadcast(hot.select(*on))
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot_lookup = _joined(lookup, keys, on, "left_semi", null_safe)
    hot_lookup = hot_lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hot_rows_ = _joined(rows, keys, on, "left_semi", null_safe)
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    hot_part = _joined(
        hot_rows_.withColumn("_salt", salt), hot_lookup, [*on, "_salt"], how, null_safe
    ).drop("_salt")
    cold_part = _joined(
        _joined(rows, keys, on, "left_anti", null_safe), lookup, on, how, null_safe
    )
    return hot_part.unionByName(cold_part)
