"""Harmonic packing of token ids into sequences of a fixed capacity.

Every document is cut into whole sequences, then into halves, quarters and so on
down to ``1 / SMALLEST_SHARE`` of the capacity, and one rest below that. A piece of
length n belongs to the class of bins that hold ``capacity // n`` pieces of just that
length, so a bin is full when it has its fixed number of pieces, whichever documents
they come from. Tasks number their pieces by class on their own; a small table of
counts per task and class turns these numbers into places, and no piece is moved or
compared with another. Bins that stay open, fewer than one per class, are packed once
more, end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, named, text_of
from millrace.llm.tokens import text_tokenizer, with_end
from millrace.scratch import Scratch

# The smallest piece cut off on purpose is this part of the capacity.
SMALLEST_SHARE = 32

# Bytes of text tokenized at a time: the arrays of a slice take many times its size.
SLICE_BYTES = 1 << 20

PIECES = (
    "doc_id long, start long, length long, doc_tokens long, ids binary, "
    "part long, class long, number long"
)
PLACED = "doc_id long, start long, length long, doc_tokens long, ids binary"


def cut_lengths(counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all pieces, document by document, and the pieces of each document."""
    shares = []
    size = capacity
    while size // 2 >= max(capacity // SMALLEST_SHARE, 1) and size % 2 == 0:
        size //= 2
        shares.append(size)
    rest = counts % capacity
    columns, sizes = [counts // capacity], [capacity]
    for size in shares:
        columns.append((rest >= size).astype(np.int64))
        sizes.append(size)
        rest = np.where(rest >= size, rest - size, rest)
    columns.append((rest > 0).astype(np.int64))
    repeats = np.stack(columns, 1)
    lengths = np.tile(np.array([*sizes, 0]), (len(counts), 1))
    lengths[:, -1] = rest
    return np.repeat(lengths.ravel(), repeats.ravel()), repeats.sum(1)


def _numbers(classes: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """Running number of each piece in its class; ``seen`` goes on between calls."""
    order = np.argsort(classes, kind="stable")
    found, first, sizes = np.unique(classes[order], return_index=True, return_counts=True)
    numbers = np.empty(len(classes), np.int64)
    base = np.array([seen.get(c, 0) for c in found.tolist()], np.int64)
    numbers[order] = np.arange(len(classes)) - np.repeat(first - base, sizes)
    for c, n in zip(found.tolist(), sizes.tolist()):
        seen[c] = seen.get(c, 0) + n
    return numbers


def _binary(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of ids as binary cells of little-endian 32-bit integers."""
    data = pa.py_buffer(np.ascontiguousarray(ids, "<u4").tobytes())
    offsets = np.concatenate([[0], np.cumsum(lengths * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), data])


def cut_texts(
    batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int | None, capacity: int, part: int
) -> Iterator[pa.RecordBatch]:
    """Pieces of all texts of one task, which is ``part``, numbered by class."""
    tokens, seen = text_tokenizer(tokenizer), {}
    for batch in batches:
        for piece in byte_slices(batch, "text", SLICE_BYTES):
            ids, counts = with_end(*tokens.encode(piece.column("text")), end_id)
            lengths, pieces = cut_lengths(counts, capacity)
            classes = np.minimum(lengths, capacity)
            numbers = _numbers(classes, seen)
            ends = np.cumsum(lengths)
            starts = ends - lengths - np.repeat(np.cumsum(counts) - counts, pieces)
            owner = np.repeat(np.arange(len(counts)), pieces)
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").take(pa.array(owner)),
                    pa.array(starts),
                    pa.array(lengths),
                    pa.array(counts[owner]),
                    _binary(ids, lengths),
                    pa.array(np.full(len(lengths), part)),
                    pa.array(classes),
                    pa.array(numbers),
                ],
                names=[f.split()[0] for f in PIECES.split(", ")],
            )


def pack_documents(
    docs: DataFrame,
    *,
    tokenizer: str,
    end_id: int | None,
    capacity: int = 2048,
    scratch: Scratch,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pack the ids of all whole texts; one row per piece.

    ``doc_id``, ``start`` (ids of the document before the piece), ``length``, ``ids``
    (binary, little-endian unsigned 32-bit), ``doc_tokens``, ``sequence_id``,
    ``offset``. Offsets of a sequence start at 0 and have no gaps; what is missing to
    the capacity is padding.

    A null text is an empty one; with ``end_id`` it has that one id, without it a
    document of no ids has no piece. Rows that share an id, null included, are packed
    each for itself. An empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(
        named(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return cut_texts(batches, tokenizer, end_id, capacity, TaskContext.get().partitionId())

    pieces = scratch.stage(rows.mapInArrow(cut, PIECES), "pieces")
    counts = scratch.stage(
        pieces.groupBy("part", "class").agg(F.count("*").alias("n")), "class-counts"
    )
    # At most one row per class: the bins that are full, and where their numbers start.
    per_bin = F.expr(f"{capacity} div class")
    totals = counts.groupBy("class").agg(F.sum("n").alias("total"))
    bins = totals.select("class", F.expr(f"total div ({capacity} div class)").alias("bins"))
    earlier = Window.orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    bins = scratch.stage(
        bins.withColumn("first_bin", F.coalesce(F.sum("bins").over(earlier), F.lit(0))), "bins"
    )
    n_bins = bins.agg(F.coalesce(F.sum("bins"), F.lit(0))).first()[0]

    before = Window.partitionBy("class").orderBy("part")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    offsets = scratch.stage(
        offsets.join(F.broadcast(bins), "class").select(
            "part", "class", "before", "bins", "first_bin"
        ),
        "class-offsets",
    )
    ranked = pieces.join(offsets, ["part", "class"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("number"))
    ranked = ranked.withColumn("bin", F.expr(f"rank div ({capacity} div class)"))
    kept = [f.split()[0] for f in PLACED.split(", ")]
    full = ranked.filter("bin < bins").select(
        *kept,
        (F.col("first_bin") + F.col("bin")).alias("sequence_id"),
        ((F.col("rank") % per_bin) * F.col("class")).alias("offset"),
    )
    left = scratch.stage(ranked.filter("bin >= bins").select("class", "rank", *kept), "left-over")
    return full.unionByName(_end_to_end(left, capacity, n_bins))


def _end_to_end(left: DataFrame, capacity: int, first_sequence: int) -> DataFrame:
    """Pieces of bins that stayed open, put end to end and cut at the capacity.

    There are fewer pieces than the bins of all classes hold together, whatever the
    size of the input: each class leaves less than one bin.
    """
    order = Window.orderBy(F.desc("class"), "rank")
    order = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = left.withColumn("at", F.coalesce(F.sum("length").over(order), F.lit(0)))
    first = F.expr(f"at div {capacity}")
    last = F.expr(f"(at + length - 1) div {capacity}")
    cut = placed.withColumn("bin", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("at"), F.col("bin") * capacity)
    end = F.least(F.col("at") + F.col("length"), (F.col("bin") + 1) * capacity)
    cut = cut.withColumn("begin", begin - F.col("at")).withColumn("size", end - begin)
    return cut.select(
        "doc_id",
        (F.col("start") + F.col("begin")).alias("start"),
        F.col("size").alias("length"),
        "doc_tokens",
        F.expr("substring(ids, cast(begin * 4 + 1 as int), cast(size * 4 as int))").alias("ids"),
        (F.lit(first_sequence) + F.col("bin")).alias("sequence_id"),
        (F.col("at") + F.col("begin") - F.col("bin") * capacity).alias("offset"),
    )
