"""Aggregates and shares built from loaded tables, and chains of transforms."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cleaning import guarded_ratio
from millrace.spec import FrameContract

log = logging.getLogger(__name__)

ON_FAILURE = ("fail_run", "skip_hook", "warn_only", "route_to_dlq")


def group_stats(
    df: DataFrame, key: str | Sequence[str], *, count: str, total: tuple[str, str], mean: tuple[str, str]
) -> DataFrame:
    """Rows, a sum and a mean cut to whole numbers per group.

    ``total`` and ``mean`` are (input column, output column).
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(
        F.count("*").alias(count),
        F.sum(total[0]).alias(total[1]),
        F.avg(mean[0]).cast("int").alias(mean[1]),
    )


def group_sums(df: DataFrame, keys: Sequence[str], **sums: str) -> DataFrame:
    """Sums per group: output column = input column."""
    return df.groupBy(*keys).agg(*[F.sum(source).alias(name) for name, source in sums.items()])


def share_of_total(
    parts: DataFrame,
    totals: DataFrame,
    on: str,
    *,
    part: str,
    whole: str,
    whole_as: str,
    share: str,
) -> DataFrame:
    """Each part with the total of its group and its share of that total.

    Both inputs are aggregates, so the join moves groups and not rows. A null
    group has no total, as in a plain left join. It is still compared null-safe,
    because the plain form makes Spark filter nulls below one side only: totals
    made from the same parts would then scan the source a second time instead of
    reusing the shuffled parts.
    """
    total = F.when(F.col(on).isNotNull(), F.col(whole))
    totals = totals.select(F.col(on).alias("_group"), total.alias(whole_as))
    joined = parts.join(totals, F.col(on).eqNullSafe(F.col("_group")), "left").drop("_group")
    return joined.withColumn(share, guarded_ratio(F.col(part), F.col(whole_as)))


def ordered_distinct(refs: DataFrame, value: str, position: str) -> DataFrame:
    """Distinct values in the order of their first position."""
    return refs.groupBy(value).agg(F.min(position).alias(position)).orderBy(position)


@dataclass(frozen=True)
class Transform:
    """One step of a chain: a function from frame to frame with its parameters.

    ``on_failure`` covers what Spark reports while the step is put together
    (unknown columns, wrong types, a broken contract, errors in the function).
    Values that only fail when the job runs are not caught here: use the
    ``try_`` functions in the step itself.
    """

    run: Callable[..., DataFrame]
    name: str = ""
    params: Mapping[str, Any] = field(default_factory=dict)
    order: int = 100
    enabled: bool = True
    on_failure: str = "fail_run"
    contract: FrameContract | None = None

    def __post_init__(self) -> None:
        if self.on_failure not in ON_FAILURE:
            raise ValueError(f"Unknown failure policy '{self.on_failure}'.")
        if not self.name:
            object.__setattr__(self, "name", getattr(self.run, "__name__", "transform"))


def run_chain(
    df: DataFrame, chain: Sequence[Transform], *, applied: list[str] | None = None
) -> DataFrame:
    """Apply the enabled transforms by (order, name); each output feeds the next.

    Names of the transforms that took effect are added to ``applied``.
    """
    for step in sorted((t for t in chain if t.enabled), key=lambda t: (t.order, t.name)):
        try:
            if step.contract:
                step.contract.check_input(df.schema)
            result = df.transform(step.run, **step.params)
            if step.contract:
                step.contract.check_output(df.schema, result.schema)
        except Exception as problem:
            if step.on_failure in ("fail_run", "route_to_dlq"):
                raise
            log.warning("Transform '%s' left out: %s", step.name, problem)
            continue
        df = result
        if applied is not None:
            applied.append(step.name)
    return df
