"""Rows in which two tables differ, found by digests of ranges of keys.

A digest is a count and two sums of row hashes, so it does not depend on the order of
rows and combines before the shuffle. Ranges of hashed keys form a tree of two levels:
all rows are digested by the ranges of the first level, those of differing ranges by
the ranges below, and only rows of differing leaves meet each other. Equal tables move
nothing but digests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.scratch import Scratch

# Ranges below each node of the tree; the first level is small enough to broadcast.
FAN = 4096

SOURCE_ROWS = "source_rows"
TARGET_ROWS = "target_rows"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _hash(seed: int, names: Sequence[str]) -> Column:
    """Hash of columns that also tells which of them are null."""
    columns = [F.col(_quoted(n)) for n in names]
    return F.xxhash64(F.lit(seed), *columns, *[c.isNull() for c in columns])


def _digests(rows: DataFrame, by: Column, names: Sequence[str], prefix: str) -> DataFrame:
    sums = [
        F.sum(_hash(seed, names).cast("decimal(38,0)")).alias(f"{prefix}_{label}")
        for seed, label in ((1, "low"), (2, "high"))
    ]
    return rows.groupBy(by.alias("_range")).agg(F.count("*").alias(f"{prefix}_rows"), *sums)


def differing_ranges(
    source: DataFrame, target: DataFrame, by: Column, names: Sequence[str]
) -> DataFrame:
    """Ranges, in ``_range``, whose rows differ in number or in content."""
    both = _digests(source, by, names, "s").join(
        _digests(target, by, names, "t"), "_range", "full_outer"
    )
    same = [F.col(f"s_{c}").eqNullSafe(F.col(f"t_{c}")) for c in ("rows", "low", "high")]
    return both.filter(~(same[0] & same[1] & same[2])).select("_range")


def row_difference(
    source: DataFrame,
    target: DataFrame,
    key: Sequence[str],
    *,
    scratch: Scratch,
    columns: Sequence[str] | None = None,
    fan: int = FAN,
) -> DataFrame:
    """Distinct rows that do not stand equally often in both tables.

    ``columns``, all of the source's by default, always with the key, are compared; the
    result has them and how often the row stands in each table, ``source_rows`` and
    ``target_rows``. A missing row has 0 on the target's side, an extra one 0 on the
    source's, a changed one is two rows of one key. Nulls are values like others, rows
    may repeat, a key may be hot, tables may be empty. Columns meet by name, in the
    type that holds both; extra columns are ignored. Maps cannot be compared.
    """
    names = list(dict.fromkeys([*key, *(columns or source.columns)]))
    chosen = [F.col(_quoted(n)) for n in names]
    pair = source.select(*chosen), target.select(*chosen)
    types = {f.name: f.dataType for f in pair[0].unionByName(pair[1]).schema}
    leaf = F.pmod(_hash(0, key), F.lit(fan * fan))
    sides = [
        side.select(*[F.col(_quoted(n)).cast(types[n]).alias(n) for n in names]).withColumn(
            "_leaf", leaf
        )
        for side in pair
    ]
    node = F.expr(f"_leaf div {fan}L")
    # At most ``fan`` numbers.
    nodes = scratch.stage(differing_ranges(*sides, node, names), "differing-nodes")
    nodes = F.broadcast(nodes)
    sides = [s.join(nodes, node == nodes["_range"], "left_semi") for s in sides]
    leaves = scratch.stage(differing_ranges(*sides, F.col("_leaf"), names), "differing-leaves")
    sides = [s.join(leaves, s["_leaf"] == leaves["_range"], "left_semi") for s in sides]
    marked = sides[0].withColumn("_source", F.lit(True)).unionByName(
        sides[1].withColumn("_source", F.lit(False))
    )
    counted = marked.groupBy(*chosen).agg(
        F.count_if("_source").alias(SOURCE_ROWS), F.count_if(~F.col("_source")).alias(TARGET_ROWS)
    )
    return counted.filter(F.col(SOURCE_ROWS) != F.col(TARGET_ROWS))
