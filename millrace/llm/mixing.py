"""Mixing sources to target weights by hierarchical budgets.

Leaves are the values of the last level (say a source) within those of the levels
above it (its language, its domain). A budget of tokens flows from the root to the
leaves by the weights of siblings. No node gets more than its leaves can give, which
is their tokens times the number of epochs allowed; what a node can't use goes to its
siblings, by weight again, and only what all of them can't use leaves the subtree, for
it was never given to the parent. Each leaf then takes all its documents once per full
epoch, and in one last epoch the prefix of a seeded order that fits its budget.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import named, text_of
from millrace.scratch import Scratch

BLANKS = " \\t\\n\\r"


def word_count(text: Column) -> Column:
    """Words between blanks, the tokens that budgets are counted in."""
    return F.regexp_count(text, F.lit(f"[^{BLANKS}]+")).cast("long")


def _whole(name: str) -> str:
    return f"cast({name} as decimal(20,0))"


def _weight(level: Column, weights: Mapping[str, int]) -> Column:
    value = F.lit(1).cast("long")
    for name, weight in weights.items():
        if weight < 0:
            raise ValueError(f"The weight of {name} is negative.")
        value = F.when(level == name, F.lit(int(weight)).cast("long")).otherwise(value)
    return value


def leaf_budgets(
    leaves: DataFrame,
    levels: Sequence[str],
    weights: Mapping[str, Mapping[str, int]],
    total: int | None,
    max_epochs: int,
) -> DataFrame:
    """``leaves`` (levels, ``tokens``) with ``budget``, tokens the leaf is to give.

    The children of a node, in the order of capacity by weight, are filled up while
    giving each of them its capacity costs no more than the node's budget, at the
    level where it is full; the others share the rest by weight.
    """
    capacity = F.sum(F.col("tokens") * max_epochs).cast("long").alias("capacity")
    top = leaves.agg(F.coalesce(capacity, F.lit(0)).alias("capacity"), F.sum("tokens").alias("t"))
    wanted = F.coalesce(F.lit(total).cast("long"), "t", F.lit(0))
    nodes = top.select(F.least("capacity", wanted).cast("long").alias("given"))
    for depth, level in enumerate(levels):
        path = list(levels[: depth + 1])
        own = leaves.groupBy(*path).agg(capacity)
        own = own.withColumn("weight", _weight(F.col(level), weights.get(level, {})))
        above = path[:-1]
        rows = own.join(nodes, above) if above else own.join(F.broadcast(nodes))
        order = F.try_divide(F.col("capacity").cast("double"), F.col("weight").cast("double"))
        order = F.coalesce(order, F.lit(float("inf")))
        siblings = Window.partitionBy(*[F.col(c) for c in above] or [F.lit(1)])
        upto = siblings.orderBy(order, level).rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.select(
            "*",
            F.sum("capacity").over(upto).alias("c_sum"),
            F.sum("weight").over(upto).alias("w_sum"),
            F.sum("weight").over(siblings).alias("w_all"),
        )
        c, w, b = _whole("capacity"), _whole("weight"), _whole("given")
        full = f"{_whole('c_sum')} * {w} + {c} * ({_whole('w_all')} - {_whole('w_sum')}) <= {b} * {w}"
        rows = rows.withColumn("full", F.expr(f"weight > 0 and {full}"))
        rows = rows.select(
            "*",
            F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(siblings).alias("c_full"),
            F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(siblings).alias("w_full"),
        )
        share = f"({w} * ({b} - {_whole('c_full')})) div ({_whole('w_all')} - {_whole('w_full')})"
        budget = F.when(F.col("full"), F.col("capacity")).when(
            F.col("weight") > 0, F.least("capacity", F.expr(share))
        )
        nodes = rows.select(*path, F.coalesce(budget, F.lit(0)).cast("long").alias("given"))
    return leaves.join(nodes.withColumnRenamed("given", "budget"), list(levels))


def _cutoffs(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The last hash of each leaf's prefix.

    ``rows`` has one row per document: ``leaf``, ``hash`` (hex), ``tokens``, ``rest``.
    Sums over buckets of the hash, 256 and 256 within each, find the one bucket where a
    leaf's prefix ends; only its rows are put in order.
    """
    rows = rows.withColumn("b1", F.substring("hash", 1, 2))
    rows = rows.withColumn("b2", F.substring("hash", 3, 2))
    fine = rows.groupBy("leaf", "rest", "b1", "b2").agg(F.sum("tokens").alias("n"))
    fine = scratch.stage(fine, "hash-buckets")
    coarse = fine.groupBy("leaf", "b1").agg(F.sum("n").alias("n1"))
    before = Window.partitionBy("leaf").orderBy("b1").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("leaf", "b1", F.coalesce(F.sum("n1").over(before), F.lit(0)).alias("s1"))
    inside = Window.partitionBy("leaf", "b1").orderBy("b2")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    fine = fine.withColumn("s2", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    fine = fine.join(coarse, ["leaf", "b1"]).withColumn("base", F.col("s1") + F.col("s2"))
    ends = fine.filter("base <= rest and base + n > rest").select("leaf", "b1", "b2", "base")
    ends = scratch.stage(ends, "last-buckets")
    last = rows.join(ends, ["leaf", "b1", "b2"])
    # Rows of one hash share one sum, so they are taken together or not at all.
    running = Window.partitionBy("leaf").orderBy("hash")
    last = last.withColumn("reached", F.col("base") + F.sum("tokens").over(running))
    taken = last.filter("reached <= rest").groupBy("leaf").agg(F.max("hash").alias("hash"))
    start = F.concat("b1", "b2")
    return ends.join(taken, "leaf", "left").select("leaf", F.coalesce("hash", start).alias("cutoff"))


def mix_sources(
    docs: DataFrame,
    *,
    levels: Mapping[str, Column],
    weights: Mapping[str, Mapping[str, int]],
    scratch: Scratch,
    total_tokens: int | None = None,
    max_epochs: int = 4,
    seed: str = "mix",
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The chosen rows: ``row`` (a struct of all input columns), the levels, ``tokens``
    (words) and ``epoch``, from 1; a row taken in several epochs comes as often.

    ``levels`` names the levels from the top with their values, ``weights`` holds whole
    weights by level and value, 1 where nothing is said, 0 to leave a value out.
    ``total_tokens`` is the budget of the root, all tokens there are by default. A null
    level counts as an empty name, a null text as an empty one. A leaf without tokens
    is taken once. Rows that share an id within a leaf are taken together; an empty
    table gives an empty result.
    """
    names = list(levels)
    keys = [F.coalesce(levels[n].cast("string"), F.lit("")).alias(n) for n in names]
    body = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    identity = named(id_column).cast("string").alias("id")
    words = word_count(text_of(text_column)).alias("tokens")
    counted = scratch.stage(docs.select(identity, *keys, words), "word-counts")
    leaves = counted.groupBy(*names).agg(F.sum("tokens").alias("tokens"))
    leaves = scratch.stage(leaves, "leaves")
    planned = leaf_budgets(leaves, names, weights, total_tokens, max_epochs)
    empty = F.col("tokens") == 0
    planned = planned.select(
        F.monotonically_increasing_id().alias("leaf"),
        *names,
        F.when(empty, 1).otherwise(F.expr("budget div tokens")).cast("long").alias("epochs"),
        F.when(empty, 0).otherwise(F.expr("budget % tokens")).cast("long").alias("rest"),
    )
    planned = scratch.stage(planned, "budgets")
    hashed = F.md5(F.concat_ws("|", F.lit(seed), F.col("epochs") + 1, "id")).alias("hash")
    open_rows = counted.join(planned.filter("rest > 0"), names)
    # Staged, for the next grouping must not inherit a partitioning by leaf.
    open_rows = scratch.stage(open_rows.select("leaf", "rest", "tokens", hashed), "open-rows")
    plan = planned.join(_cutoffs(open_rows, scratch), "leaf", "left").drop("leaf", "rest")
    plan = scratch.stage(plan, "plan")

    chosen = docs.select(body, identity, *keys, words).join(plan, names)
    once_more = F.coalesce(hashed <= F.col("cutoff"), F.lit(False)).cast("long")
    chosen = chosen.withColumn("copies", F.col("epochs") + once_more).filter("copies > 0")
    epoch = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("epoch")
    return chosen.select("row", *names, "tokens", epoch)
