"""Aggregates that are kept up to date from changes, with what a row added taken back."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
ROWS = "_rows"


@dataclass(frozen=True)
class GroupStates:
    """Counts, sums and truncated means of groups, in a form that changes can be added to.

    A state has the rows of its group and, for each measured column, the sum and the
    number of its values that are not null. States are added and subtracted, so the
    state of a table after a change is that before it, plus what came, less what went.
    Measured columns are whole numbers or decimals: sums of those are exact in any order.

    ``count`` names the count of rows; ``sums`` and ``means`` map output names to input
    columns. Null keys are a group of their own.
    """

    keys: tuple[str, ...]
    count: str | None = None
    sums: Mapping[str, str] = field(default_factory=dict)
    means: Mapping[str, str] = field(default_factory=dict)

    @property
    def measured(self) -> list[str]:
        return sorted({*self.sums.values(), *self.means.values()})

    def states(self, rows: DataFrame, *, sign: str | None = None) -> DataFrame:
        """States of the rows; with ``sign``, a column of 1 and -1, what they change."""
        for name in self.measured:
            if not isinstance(rows.schema[name].dataType, EXACT):
                raise TypeError(f"Sums of '{name}' are not exact: it is no whole number or decimal.")
        each = F.col(sign).cast("long") if sign else F.lit(1).cast("long")
        parts = [F.sum(each).alias(ROWS)]
        for name in self.measured:
            value = F.col(f"`{name}`")
            parts += [
                F.coalesce(F.sum(value.cast(_wide(rows, name)) * each), F.lit(0))
                .cast(_wide(rows, name)).alias(f"_sum_{name}"),
                F.sum(F.when(value.isNotNull(), each).otherwise(0)).alias(f"_n_{name}"),
            ]
        return rows.groupBy(*self.keys).agg(*parts)

    def merged(self, stored: DataFrame, change: DataFrame) -> DataFrame:
        """Stored states with a change added; groups left without rows are gone.

        Both sides have one row per group, so no group is large.
        """
        numbers = [c for c in stored.columns if c not in self.keys]
        added = stored.unionByName(change).groupBy(*self.keys)
        added = added.agg(*[F.sum(c).cast(stored.schema[c].dataType).alias(c) for c in numbers])
        return added.filter(F.col(ROWS) != 0).select(*stored.columns)

    def finish(self, states: DataFrame) -> DataFrame:
        """The aggregates; a sum or mean of no values is null."""

        def over(name: str, value: Column) -> Column:
            return F.when(F.col(f"_n_{name}") > 0, value)

        columns = [F.col(f"`{key}`") for key in self.keys]
        if self.count:
            columns.append(F.col(ROWS).alias(self.count))
        for target, name in self.sums.items():
            columns.append(over(name, F.col(f"_sum_{name}")).alias(target))
        for target, name in self.means.items():
            # Both parts are exact, and so is their quotient cut to a whole number.
            quotient = F.expr(f"`_sum_{name}` div `_n_{name}`")
            columns.append(over(name, quotient).cast("int").alias(target))
        return states.select(*columns)


def _wide(rows: DataFrame, name: str) -> str:
    kind = rows.schema[name].dataType
    return f"decimal(38,{kind.scale})" if isinstance(kind, T.DecimalType) else "bigint"
