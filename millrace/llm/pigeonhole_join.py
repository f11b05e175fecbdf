"""Near-duplicate vectors by a subspace pigeonhole join.

On the unit sphere a cosine of c is a squared distance of 2 - 2c. Vectors are rotated
at random and split into blocks of a few dimensions; if all of them together differ by
no more than that budget, at least one block differs by no more than its proportional
part. So each block is range-joined alone: its rows are halved into cells, and a cell
meets only the rows that its range reaches. What is close in a block is a candidate and
verified by its cosine in double precision. A pair counts in the first block that finds
it, so the union over blocks needs no further join.

Vectors are moved once, to files of a bounded number of rows of one kind. A task reads
two of these, a tile, cuts its cells in memory, and reports sums of links and a spanning
forest, never all pairs; so what is written grows with the rows, not with the tiles.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from millrace.llm.common import named, open_folder
from millrace.llm.components import connected_components, smallest_reachable
from millrace.scratch import Scratch

BLOCK_DIMS = 16

# Vectors of one side of a tile, and numbers in them; small tables have fewer, down to
# the least, so that there are some tiles for each core.
TILE_ROWS = 1 << 16
TILE_NUMBERS = 3 << 20
LEAST_ROWS = 4_096
SIDES = 16

# Vectors of a cell.
CELL_ROWS = 1_024

# Pairs that are compared without cells, numbers of whole vectors gathered at a time, and
# linked pairs held until they are summed.
FEW_PAIRS = 1 << 10
GATHERED = 1 << 20
HELD_PAIRS = 1 << 20

# Lists of tiles, each of which is one row for a task.
TASK_ROWS = 20_000
TASKS = 2_000

# Beyond the rounding of squared distances in single precision.
SLACK = 1e-5

MERGED = "group int, kind string, unit array<{0}>, copies long, first long"
FOUND = "node long, links long, other long"


@lru_cache(maxsize=4)
def rotation(dims: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))[0]


def blocks(dims: int) -> list[slice]:
    return [slice(at, min(at + BLOCK_DIMS, dims)) for at in range(0, dims, BLOCK_DIMS)]


def block_budgets(dims: int, cosine: float) -> np.ndarray:
    """Squared distance allowed in each block, by its share of the dimensions."""
    return np.array([(2 - 2 * cosine) * (b.stop - b.start) / dims + SLACK for b in blocks(dims)])


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null, no infinity, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def digest(kind: Column, unit: Column) -> list[Column]:
    """128 bits of a vector and its kind; 0.0 and -0.0 count as equal, as in groups."""
    return [
        F.xxhash64(kind, unit).alias("hash"), F.xxhash64(F.lit(1), unit, kind).alias("other_hash")
    ]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector of a batch once, with the number and the smallest id of its copies."""
    for batch in batches:
        unit, n = batch.column("unit"), batch.num_rows
        flat = np.asarray(unit.flatten()) + 0.0  # no -0.0
        ends = np.asarray(unit.offsets, dtype=np.int64)
        ends = (ends - ends[0]) * flat.itemsize
        raw = pa.Array.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())]
        )
        rows = pa.table({
            "kind": batch.column("kind"), "raw": raw, "row": np.arange(n), "id": batch.column("vec_id")
        })
        alike = rows.group_by(["kind", "raw"], use_threads=False)
        alike = alike.aggregate([("row", "min"), ("row", "count"), ("id", "min")]).combine_chunks()
        kept = batch.take(alike.column("row_min").combine_chunks())
        counts = [alike.column(c).combine_chunks() for c in ("row_count", "id_min")]
        yield pa.RecordBatch.from_arrays(
            [kept.column("group"), kept.column("kind"), kept.column("unit"), *counts],
            names=["group", "kind", "unit", "copies", "first"],
        )


def _halves(rows: np.ndarray, points: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The rows with the smaller and the larger numbers in their widest dimension."""
    widest = int(np.argmax(points.max(1) - points.min(1)))
    order = np.argpartition(points[widest], len(rows) // 2)
    parts = order[: len(rows) // 2], order[len(rows) // 2 :]
    return [(rows[part], points.take(part, 1)) for part in parts]


def _reached(
    side: tuple[np.ndarray, np.ndarray], cell: np.ndarray, budget: float
) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose squared distance to the box around a cell is within the budget."""
    rows, points = side
    low, high = cell.min(1)[:, None], cell.max(1)[:, None]
    gap = np.abs(points - (low + high) / 2)
    gap -= (high - low) / 2
    np.maximum(gap, 0, out=gap)
    gap *= gap
    hit = np.flatnonzero(gap.sum(0) <= budget + SLACK)
    return side if len(hit) == len(rows) else (rows[hit], points.take(hit, 1))


def _close(
    points: np.ndarray, left: np.ndarray, right: np.ndarray | None, budget: float, cell_rows: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a left and a right row that may be within the budget, by cells.

    ``points`` has a row per dimension. Without right rows the pairs are those among
    the left ones, each once.
    """

    def side(rows):
        return rows, points.take(rows, 1)

    todo = [(side(left), None if right is None else side(right))]
    while todo:
        a, b = todo.pop()
        if b is None and len(a[0]) > cell_rows:
            one, two = _halves(*a)
            todo += [(one, None), (two, None), (one, two)]
            continue
        if b is not None and max(len(a[0]), len(b[0])) > cell_rows:
            if len(a[0]) < len(b[0]):
                a, b = b, a
            for half in _halves(*a):
                near = _reached(b, half[1], budget)
                if len(near[0]):
                    todo.append((half, near))
            continue
        (i, x), (j, y) = a, a if b is None else b
        # The product of these is the squared distance.
        x = np.concatenate([x, (x * x).sum(0)[None], np.ones((1, len(i)), x.dtype)])
        y = np.concatenate([-2 * y, np.ones((1, len(j)), y.dtype), (y * y).sum(0)[None]])
        hit = np.flatnonzero(x.T @ y <= budget + SLACK)
        if len(hit):
            p, q = np.divmod(hit, len(j))
            if b is None:
                once = p < q
                p, q = p[once], q[once]
            yield i[p], j[q]


def _linked(
    vectors: np.ndarray, left: np.ndarray, right: np.ndarray | None, cosine: float, cell_rows: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of a left and a right row, or of two left ones without right rows."""
    n, dims = vectors.shape
    some = max(1, GATHERED // dims)
    few = len(left) * (len(left) if right is None else len(right)) <= FEW_PAIRS
    length = np.empty(n)
    turned = None if few else np.empty((n, dims), np.float32)
    for at in range(0, n, some):
        exact = vectors[at : at + some].astype(np.float64)
        length[at : at + some] = np.sqrt(np.einsum("ij,ij->i", exact, exact))
        if not few:
            with np.errstate(all="ignore"):
                exact /= length[at : at + some, None]
            turned[at : at + some] = exact @ rotation(dims)
    # Squares that leave the range of doubles tell no direction.
    sound = np.isfinite(length) & (length > 0)
    left, right = left[sound[left]], None if right is None else right[sound[right]]
    if not len(left) or right is not None and not len(right):
        return

    def verified(i, j):
        a, b = vectors[i].astype(np.float64), vectors[j].astype(np.float64)
        linked = np.einsum("ij,ij->i", a, b) / (length[i] * length[j]) >= cosine
        return i[linked], j[linked]

    if few:
        if right is None:
            i, j = np.triu_indices(len(left), 1)
            i, j = left[i], left[j]
        else:
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        for at in range(0, len(i), some):
            yield verified(i[at : at + some], j[at : at + some])
        return
    budgets = block_budgets(dims, cosine)
    starts = [block.start for block in blocks(dims)]
    for number, block in enumerate(blocks(dims)):
        points = np.ascontiguousarray(turned[:, block].T)
        for i, j in _close(points, left, right, budgets[number], cell_rows):
            for at in range(0, len(i), some):
                a, b = i[at : at + some], j[at : at + some]
                gap = turned[a] - turned[b]
                gap *= gap
                gap = np.add.reduceat(gap, starts, axis=1)
                near = gap <= budgets
                first = near[:, number] & ~near[:, :number].any(1)
                first &= gap.sum(1) <= 2 - 2 * cosine + SLACK
                yield verified(a[first], b[first])


def tile_links(tile: pa.Table, cosine: float, cell_rows: int = CELL_ROWS) -> pa.Table:
    """Links between the left and the right rows of a tile; a row can be both.

    ``links`` of a row are those of its distinct partners, weighted by copies; ``other``
    is a node it is connected with.
    """
    left, right = (tile.column(c).to_numpy() for c in ("left", "right"))
    n = tile.num_rows
    empty = pa.table({c: pa.array([], pa.int64()) for c in ("node", "links", "other")})
    if not n:
        return empty
    flat = tile.column("unit").combine_chunks().flatten()
    vectors = np.asarray(flat).reshape(n, -1)
    node, copies = tile.column("node").to_numpy(), tile.column("copies").to_numpy()
    links, root, held = np.zeros(n), np.arange(n), []

    def add():
        nonlocal links, root
        a, b = (np.concatenate(x) for x in zip(*held))
        links += np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        root = smallest_reachable(
            n, np.concatenate([a, np.arange(n)]), np.concatenate([b, root])
        )
        held.clear()

    both, every = left & right, np.flatnonzero
    sides = [(both, None), (left, right & ~left), (left & ~right, both)]
    for one, two in sides:
        one, two = every(one), None if two is None else every(two)
        if not len(one) or two is not None and not len(two):
            continue
        number = 0
        for pairs in _linked(vectors, one, two, cosine, cell_rows):
            number += len(pairs[0])
            if len(pairs[0]):
                held.append(pairs)
            if number >= HELD_PAIRS:
                add()
                number = 0
        if held:
            add()
    hit = np.flatnonzero(links)
    if not len(hit):
        return empty
    return pa.table(
        {"node": node[hit], "links": links[hit].astype("int64"), "other": node[root[hit]]}
    )


def _tile(store, folder: str, left: list, right: list) -> pa.Table:
    """Rows of the groups of both sides; without a right side the left one meets itself."""

    def read(groups, is_left, is_right):
        tables = []
        for file in sorted({f for f, _ in groups}):
            wanted = [g for f, g in groups if f == file]
            data = ds.dataset(f"{folder}/{file}", format="parquet", filesystem=store)
            tables.append(data.to_table(
                ["node", "copies", "kind", "unit"], filter=ds.field("group").isin(wanted),
                use_threads=False,
            ))
        table = pa.concat_tables(tables)
        for name, flag in (("left", is_left), ("right", is_right)):
            table = table.append_column(name, pa.array(np.full(table.num_rows, flag)))
        return table

    if not right:
        return read(left, True, True)
    return pa.concat_tables([read(left, True, False), read(right, False, True)])


def _links_of_tiles(
    batches: Iterator[pa.RecordBatch], folder: str, cosine: float, cell_rows: int
) -> Iterator[pa.RecordBatch]:
    """Links of the tiles that the rows list, kind by kind."""
    store, at = open_folder(folder)
    for batch in batches:
        for listed in batch.column("tiles").to_pylist():
            listed = json.loads(listed)
            for right in listed["right"]:
                tile = _tile(store, at, listed["left"], right).combine_chunks()
                codes = np.asarray(tile.column("kind").combine_chunks().dictionary_encode().indices)
                order = np.argsort(codes, kind="stable")
                ends = np.flatnonzero(np.diff(codes[order], append=-1)) + 1
                if len(ends) > 1:
                    tile = tile.take(order)
                start = 0
                parts = []
                for end in ends.tolist():
                    parts.append(tile_links(tile.slice(start, end - start), cosine, cell_rows))
                    start = end
                if parts:
                    yield from pa.concat_tables(parts).combine_chunks().to_batches()


def _tasks(held: list, kinds: list[tuple[int, int, int]]) -> list[tuple[str]]:
    """Lists of tiles: each shared group with itself, of large kinds all pairs of sides.

    ``held`` has group, file and rows; ``kinds`` first group, end and rows of a side.
    """
    files: dict[int, list] = {}
    rows: dict[int, int] = {}
    for group, file, n in held:
        files.setdefault(group, []).append([file.rsplit("/", 1)[1], group])
        rows[group] = rows.get(group, 0) + n
    families = []
    for start, end, most in kinds:
        # Groups have room for copies; without these some make one side.
        sides, size = [], 0
        for group in (g for g in range(start, end) if g in files):
            if not sides or size + rows[group] > most:
                sides.append([])
                size = 0
            sides[-1] += files[group]
            size += rows[group]
        families.append(sides)
    large = {g for start, end, _ in kinds for g in range(start, end)}
    families += [[files[g]] for g in files if g not in large]
    run = 1 + sum(len(sides) * (len(sides) + 1) // 2 for sides in families) // TASK_ROWS
    tasks = []
    for sides in families:
        for i, left in enumerate(sides):
            rights = [[], *sides[i + 1 :]]
            for at in range(0, len(rights), run):
                tasks.append((json.dumps({"left": left, "right": rights[at : at + run]}),))
    return tasks


def near_vectors(
    vectors: DataFrame,
    *,
    scratch: Scratch,
    cosine: float = 0.93,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable) and ``kept`` (whether it is that one).

    Rows are linked when their labels are equal and the cosine of their vectors is
    ``cosine`` or more. A null label, a null, empty or zero vector and one with null
    or non-finite components link with nothing, nor do vectors of different lengths.
    Singles are compared as such, all other numbers as doubles.
    Repeated vectors are joined once and counted as often. Rows that share an id
    each have their row; ids are whole numbers, and a null id is the smallest of its
    component only if there is no other. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = scratch.spark
    given = vectors.select(named(vector_column)).schema[0].dataType
    single = isinstance(given, ArrayType) and isinstance(given.elementType, FloatType)
    number_type = "float" if single else "double"
    rows = vectors.select(
        named(id_column).cast("long").alias("vec_id"),
        named(vector_column).cast(f"array<{number_type}>").alias("unit"),
        named(label_column).cast("string").alias("kind"),
    )
    rows = rows.withColumn("kind", F.concat(F.size("unit").cast("string"), F.lit("/"), "kind"))
    good = F.col("kind").isNotNull() & usable(F.col("unit"))
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))

    # Rows with unusable vectors are counted as well: sizes of groups need no exact counts.
    kinds = rows.filter("kind IS NOT NULL AND size(unit) > 0")
    kinds = kinds.groupBy("kind", F.size("unit").alias("dims")).agg(F.count("*").alias("n"))
    kinds = scratch.stage(kinds, "kinds")
    total = kinds.agg(F.sum("n")).first()[0] or 0
    side = min(TILE_ROWS, max(LEAST_ROWS, -(-total // SIDES)))
    by_numbers = F.floor(F.lit(TILE_NUMBERS) / F.col("dims"))
    kinds = kinds.withColumn("most", F.greatest(F.lit(1), F.least(F.lit(side), by_numbers)))
    share = F.sum(F.col("n") / F.col("most"))
    shared = int(np.ceil(kinds.filter("n <= most").agg(share).first()[0] or 0)) or 1
    large, end = [], shared
    for r in kinds.filter("n > most").orderBy("kind").collect():
        large.append((r.kind, end, -(-r.n // r.most), r.most))
        end += large[-1][2]
    of_kind = spark.createDataFrame([r[:3] for r in large], "kind string, start int, slots int")
    # Equal vectors have one group; a large kind has groups of its own.
    group = F.coalesce(
        F.col("start") + F.pmod(F.xxhash64("unit"), F.col("slots")),
        F.pmod(F.xxhash64("kind"), F.lit(shared)),
    )
    grouped = rows.filter("good").join(F.broadcast(of_kind), "kind", "left")
    grouped = grouped.select(group.cast("int").alias("group"), "kind", "unit", "vec_id")
    merged = grouped.mapInArrow(_merged, MERGED.format(number_type))
    alike = merged.repartitionById(end, "group").groupBy("group", "kind", "unit")
    distinct = alike.agg(F.sum("copies").alias("copies"), F.min("first").alias("first"))
    distinct = distinct.select(F.monotonically_increasing_id().alias("node"), "*")
    folder = scratch.path("distinct-vectors")
    distinct.write.parquet(folder)
    distinct = spark.read.schema(distinct.schema).parquet(folder)

    files = distinct.select("group", F.input_file_name().alias("file"))
    held = [tuple(r) for r in files.groupBy("group", "file").count().orderBy("group", "file").collect()]
    tasks = _tasks(held, [(start, start + slots, most) for _, start, slots, most in large])
    tiles = spark.createDataFrame(tasks, "tiles string").repartition(max(1, min(len(tasks), TASKS)))
    cell_rows = CELL_ROWS
    found = tiles.mapInArrow(lambda b: _links_of_tiles(b, folder, cosine, cell_rows), FOUND)
    found = scratch.stage(found, "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.filter("node != other").select(F.col("node").alias("a"), F.col("other").alias("b"))
    parts_of = connected_components(edges, scratch)

    # Digests stand for the vectors if no two of these share one.
    hashed = digest(F.col("kind"), F.col("unit"))
    hashes = distinct.select(*hashed)
    clash = hashes.groupBy(*hashes.columns).count().filter("count > 1")
    key = ["kind", "unit"] if clash.take(1) else hashes.columns
    placed = distinct.select("node", "copies", "first", "kind", "unit", *hashed)
    placed = placed.select("node", "copies", "first", *key)
    placed = placed.join(links, "node", "left").join(parts_of, "node", "left")
    placed = placed.withColumn("root", F.coalesce("component", "node"))
    lowest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = placed.join(lowest, "root").select(
        *key, "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    placed = scratch.stage(placed, "placed")
    linked = rows.filter("good").select("vec_id", "kind", "unit", *hashed).select("vec_id", *key)
    linked = linked.join(placed, key)
    alone = rows.filter("not good").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    linked = linked.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    return linked.unionByName(alone).withColumn(
        "kept", F.col("vec_id").eqNullSafe(F.col("component_id"))
    )
