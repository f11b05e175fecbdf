"""What a row of filters removes, for every order in which they could be applied.

A document fails some of the filters; which ones is its mask, a set of bits. All that
can be asked about orders depends on the mask alone, so documents are first counted
into mask cells. Each cell then folds across the array of all orders: ``transform``
goes through the orders, ``aggregate`` through the filters of one, carrying the bits of
the filters that came before. That yields one struct of weights per order and step, and
the structs of a part's cells are merged by elementwise sums. A part has at most
2^filters cells, so what is folded does not grow with the documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import named, text_of
from millrace.scratch import Scratch

# All orders of more filters than this are no array for a plan.
MOST_FILTERS = 6

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")

BLANKS = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The filters that judge a text by itself; true where it fails.

    A: under 50 words. B: distinct words under 65 percent of the words. C: capital
    letters A-Z over 5 percent of the code points. D: any of ``#$%&*|``. Words are
    runs without ASCII blanks, case counts.
    """
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    n_words = F.size(words).cast("long")
    n_distinct = F.size(F.array_distinct(words)).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    return {
        "A": n_words < 50,
        "B": n_distinct * 100 < n_words * 65,
        "C": capitals * 100 > F.char_length(text).cast("long") * 5,
        "D": text.rlike("[#$%&*|]"),
    }


def with_repeats(rows: DataFrame, digest: str, id_column: str, name: str) -> DataFrame:
    """Rows and whether a smaller id has the same digest.

    The smallest id of a digest comes out of a combined aggregation; rows look it up
    by digest and id together, so that the copies of one text are spread by their ids.
    """
    first = rows.filter(named(id_column).isNotNull()).groupBy(digest)
    first = first.agg(F.min(id_column).alias(id_column)).withColumn("_first", F.lit(True))
    joined = rows.join(first, [digest, id_column], "left")
    later = F.col("_first").isNull() & named(id_column).isNotNull()
    return joined.withColumn(name, later).drop("_first")


def mask_cells(
    rows: DataFrame, failures: Mapping[str, Column], *, part: Column, good: Column, toxic: Column
) -> DataFrame:
    """Documents by part and mask: ``part``, ``mask``, ``n``, ``good``, ``toxic``."""
    mask = F.lit(0)
    for i, failed in enumerate(failures.values()):
        mask = mask + F.coalesce(failed, F.lit(False)).cast("int") * (1 << i)
    return rows.groupBy(part.alias("part"), mask.alias("mask")).agg(
        F.count("*").alias("n"),
        F.count_if(F.coalesce(good, F.lit(False))).alias("good"),
        F.count_if(F.coalesce(toxic, F.lit(False))).alias("toxic"),
    )


def _fold(cell: Column, orders: Column) -> Column:
    """Weights of one cell at all steps of all orders, one struct each."""
    mask, none = cell["mask"], F.lit(0).cast("long")

    def step(before: Column, bit: Column) -> Column:
        fails = mask.bitwiseAND(bit) != 0
        alive = mask.bitwiseAND(before) == 0
        here = alive & fails
        return F.struct(
            bit.alias("bit"),
            F.when(alive & ~fails, cell["n"]).otherwise(none).alias("kept"),
            F.when(here, cell["n"]).otherwise(none).alias("removed"),
            F.when(~alive & fails, cell["n"]).otherwise(none).alias("redundant"),
            F.when(mask == bit, cell["n"]).otherwise(none).alias("unique_fails"),
            F.when(here, cell["good"]).otherwise(none).alias("good_lost"),
            F.when(here, cell["toxic"]).otherwise(none).alias("toxic_lost"),
        )

    fields = ", ".join(f"{c}: bigint" for c in COUNTS)
    nothing = F.array().cast(f"array<struct<bit: int, {fields}>>")

    def along(order: Column) -> Column:
        start = F.struct(F.lit(0).alias("before"), nothing.alias("steps"))
        return F.aggregate(
            order,
            start,
            lambda state, bit: F.struct(
                state["before"].bitwiseOR(bit).alias("before"),
                F.concat(state["steps"], F.array(step(state["before"], bit))).alias("steps"),
            ),
            lambda state: state["steps"],
        )

    return F.flatten(F.transform(orders, along))


def _sum(a: Column, b: Column) -> Column:
    added = [(a[c] + b[c]).alias(c) for c in COUNTS]
    return F.struct(F.greatest(a["bit"], b["bit"]).alias("bit"), *added)


def filter_orders(cells: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from the cells of ``mask_cells``.

    ``part``, ``filter_order`` (a word of all letters, applied left to right), ``step``
    from 1, and counts of documents: ``kept`` after the step, ``removed`` by it,
    ``redundant`` (failing its filter, removed before), ``unique_fails`` (failing its
    filter alone), ``good_lost`` and ``toxic_lost`` (removed by the step), and
    ``shapley``, what its filter removes in all orders together.

    Parts without cells have no rows, so an empty table gives an empty result.
    """
    if not 0 < len(letters) <= MOST_FILTERS:
        raise ValueError(f"Between 1 and {MOST_FILTERS} filters are compared.")
    bits = {letter: 1 << i for i, letter in enumerate(letters)}
    names = ["".join(order) for order in permutations(letters)]
    orders = F.array(*[F.array(*[F.lit(bits[c]) for c in name]) for name in names])
    size = len(names) * len(letters)
    zero = F.struct(F.lit(0).alias("bit"), *[F.lit(0).cast("long").alias(c) for c in COUNTS])
    # The bits of a part's cells are distinct masks, so this list is bounded.
    parts = cells.groupBy("part").agg(
        F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")
    )
    merged = F.aggregate(
        "cells",
        F.array_repeat(zero, size),
        lambda total, cell: F.zip_with(total, _fold(cell, orders), _sum),
    )
    merged = parts.select("part", merged.alias("steps"))

    def removed_by(bit: int) -> Column:
        own = F.filter("steps", lambda s: s["bit"] == bit)
        return F.aggregate(own, F.lit(0).cast("long"), lambda total, s: total + s["removed"])

    by_filter = [removed_by(bit) for bit in bits.values()]
    rows = merged.select(
        "part",
        F.map_from_arrays(F.array(*map(F.lit, bits.values())), F.array(*by_filter)).alias("by"),
        F.posexplode("steps").alias("at", "one"),
    )
    number = F.expr(f"at div {len(letters)}").cast("int")
    return rows.select(
        "part",
        F.get(F.array(*map(F.lit, names)), number).alias("filter_order"),
        (F.col("at") % len(letters) + 1).alias("step"),
        *[F.col(f"one.{c}").alias(c) for c in COUNTS],
        F.col("by")[F.col("one.bit")].alias("shapley"),
    )


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    *,
    scratch: Scratch,
    id_column: str = "doc_id",
    text_column: str = "text",
    part_column: str = "source",
) -> DataFrame:
    """``filter_orders`` of the filters A to E on whole documents.

    E: the text is that of a smaller id anywhere in the table, whatever becomes of that
    document; texts are compared by their SHA-256. ``labels`` has ``doc_id``,
    ``quality`` and ``toxic``; a document is good or toxic if any label of its id says
    1. A null text is an empty one, a null part an empty string. A row without an id
    repeats nothing, is repeated by nothing and has no label; rows that share id and
    text count each, and none of them repeats another. Other columns are ignored.
    """
    text = F.col("text")
    read = docs.select(
        named(id_column).alias("id"),
        text_of(part_column).alias("part"),
        text_of(text_column).alias("text"),
    )
    judged = read.select(
        "id",
        "part",
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        *[failed.alias(letter) for letter, failed in text_failures(text).items()],
    )
    rows = with_repeats(scratch.stage(judged, "judged"), "digest", "id", "E")
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    cells = mask_cells(
        rows.join(known, "id", "left"),
        {letter: F.col(letter) for letter in "ABCDE"},
        part=F.col("part"),
        good=F.col("good"),
        toxic=F.col("toxic"),
    )
    return filter_orders(scratch.stage(cells, "mask-cells"), "ABCDE")
