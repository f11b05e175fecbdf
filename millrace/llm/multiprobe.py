"""Nearest neighbours by inner product with multiprobe p-stable hashing.

Vectors are scaled into the unit ball and get one more coordinate that lifts them onto
the sphere; queries are scaled to length one. Distances there order candidates exactly
as inner products do, so Gaussian (2-stable) projections, shifted and cut into slots,
hash them: a table's bucket is the row of slots of its projections. A query visits not
only its own bucket but, in the order of their estimated success, the buckets around
it: that of a bucket is the probability that a neighbour's projections fall in its
slots, given the query's.

How many projections a table has follows from the number of rows, how many buckets a
query visits from a bounded sample of queries whose true neighbours are found first.
Buckets with many rows are cut into tiles of bounded size, and each tile is scored as
one matrix product. What the tables find is merged by query, scores are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, product
from math import comb, erf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import named
from millrace.llm.pigeonhole_join import usable
from millrace.operators.lookups import join_lookup
from millrace.scratch import Scratch

TABLES = 4

# Queries whose true neighbours decide how many buckets are visited.
SAMPLE_QUERIES = 256

# Share of the sample's neighbours that the visited buckets must hold.
TARGET = 0.96

# Buckets visited per table at most; if they do not suffice, buckets become larger.
MAX_PROBES = 8

# Perturbed buckets that are put in order for a query, its own included.
MAX_PERTURBATIONS = 6_561

# Rows a bucket should hold where all projections are told apart.
BUCKET_ROWS = 32
MAX_PROJECTIONS = 16

# A slot in standard deviations of a projection; some 2.3 slots are in use.
SLOT_WIDTH = 3.0
SLOTS_IN_USE = 2.3

# Rows of one side of a tile, and of queries scored at a time.
TILE_ROWS = 8_192
SLICE_ROWS = 256


def dense(lists: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of a matrix; shorter ones are filled with zeros."""
    sizes = np.diff(np.asarray(lists.offsets))
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    if (sizes == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of the unit ball on the sphere with one more dimension."""
    inside = vectors / longest
    height = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", inside, inside)))
    return np.column_stack([inside, height])


def levelled(queries: np.ndarray) -> np.ndarray:
    """Queries of length one; their place in the added dimension is 0."""
    length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    return np.column_stack([queries / length[:, None], np.zeros(len(queries))])


def perturbations(projections: int) -> np.ndarray:
    """Steps to slots beside one's own: as many of them changed as the limit allows."""
    most, total = 0, 1
    while most < projections:
        total += comb(projections, most + 1) * 2 ** (most + 1)
        if total > MAX_PERTURBATIONS:
            break
        most += 1
    rows = [np.zeros((1, projections), np.int8)]
    for changed in range(1, most + 1):
        signs = np.array(list(product((-1, 1), repeat=changed)), np.int8)
        for places in combinations(range(projections), changed):
            steps = np.zeros((len(signs), projections), np.int8)
            steps[:, places] = signs
            rows.append(steps)
    return np.concatenate(rows)


def _normal_cdf(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(erf, otypes=[float])(z / np.sqrt(2)))


@dataclass
class Hashing:
    """Projections, offsets and slot widths of all tables, one table after another."""

    axes: np.ndarray
    offsets: np.ndarray
    widths: np.ndarray
    projections: int
    likeness: float = 0.0
    probes: int = 1

    @classmethod
    def draw(cls, sample: np.ndarray, projections: int, seed: int = 23) -> Hashing:
        """Gaussian projections; slots are as wide as ``sample`` spreads on them."""
        rng = np.random.default_rng(seed)
        axes = rng.normal(size=(sample.shape[1], TABLES * projections))
        spread = (sample @ axes).std(0)
        widths = SLOT_WIDTH * np.where(spread > 0, spread, 1.0)
        return cls(axes, rng.uniform(0, 1, TABLES * projections) * widths, widths, projections)

    @property
    def tables(self) -> list[slice]:
        return [slice(t * self.projections, (t + 1) * self.projections) for t in range(TABLES)]

    def slots(self, points: np.ndarray) -> np.ndarray:
        return np.floor((points @ self.axes + self.offsets) / self.widths).astype(np.int64)

    def buckets(self, slots: np.ndarray, table: int) -> np.ndarray:
        """One number per row of a table's slots; equal rows have equal numbers."""
        mixed = np.random.default_rng(table).integers(0, 1 << 64, dtype=np.uint64)
        found = np.full(len(slots), mixed)
        for column in slots.astype(np.uint64).T:
            found = (found ^ column) * np.uint64(0x9E3779B97F4A7C15)
            found ^= found >> np.uint64(29)
        return found.view(np.int64)

    def order(self, points: np.ndarray, table: int, steps: np.ndarray) -> np.ndarray:
        """Perturbations of each point, by falling probability to hold a neighbour.

        A neighbour's projection is normal around that of the query, drawn towards 0
        by their likeness.
        """
        part = self.tables[table]
        place = points @ self.axes[:, part]
        slot = np.floor((place + self.offsets[part]) / self.widths[part])
        low = slot * self.widths[part] - self.offsets[part]
        rest = np.sqrt(max(1 - self.likeness**2, 0.0025))
        scale = self.widths[part] / SLOT_WIDTH * rest
        edges = [
            _normal_cdf((low + i * self.widths[part] - self.likeness * place) / scale)
            for i in (-1, 0, 1, 2)
        ]
        cost = -np.log(np.maximum(np.diff(np.stack(edges), axis=0), 1e-12))
        total = np.zeros((len(points), len(steps)))
        for i in range(self.projections):
            total += cost[:, :, i].T[:, steps[:, i] + 1]
        return np.argsort(total, axis=1, kind="stable")

    def visits(self, points: np.ndarray, table: int, steps: np.ndarray) -> np.ndarray:
        """Numbers of the buckets each point visits, best first."""
        first = self.order(points, table, steps)[:, : self.probes]
        own = self.slots(points)[:, self.tables[table]]
        there = own[:, None, :] + steps[first]
        return self.buckets(there.reshape(-1, self.projections), table).reshape(first.shape)


def probes_needed(
    hashing: Hashing, queries: np.ndarray, neighbours: np.ndarray, owner: np.ndarray
) -> np.ndarray:
    """For each neighbour of ``queries[owner]`` the visits per table after which some
    table has found it; a number beyond all perturbations if none does."""
    steps = perturbations(hashing.projections)
    powers = 3 ** np.arange(hashing.projections, dtype=np.int64)
    codes = (steps + 1).astype(np.int64) @ powers
    by_code = np.argsort(codes)
    best = np.full(len(owner), len(steps) + 1)
    gaps = hashing.slots(neighbours) - hashing.slots(queries)[owner]
    for table, part in enumerate(hashing.tables):
        order = hashing.order(queries, table, steps)
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(len(steps))[None, :], 1)
        gap = gaps[:, part]
        near = (np.abs(gap) <= 1).all(1)
        code = (np.clip(gap, -1, 1) + 1) @ powers
        at = by_code[np.minimum(np.searchsorted(codes[by_code], code), len(codes) - 1)]
        hit = near & (codes[at] == code)
        best = np.where(hit, np.minimum(best, rank[owner, at] + 1), best)
    return best


def _top(
    queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, vector row and score of the k best vectors of each query.

    The matrix product finds them but for rounding, then each score is summed alone,
    so that equal vectors score alike wherever they stand; ties go to the smaller id.
    """
    found = []
    for start in range(0, len(queries), SLICE_ROWS):
        some = queries[start : start + SLICE_ROWS]
        rough = some @ vectors.T
        least = np.full(len(some), -np.inf)
        if len(vectors) > k:
            least = np.partition(rough, len(vectors) - k, axis=1)[:, len(vectors) - k]
        margin = 1e-12 * len(vectors[0]) * np.abs(rough).max(1)
        i, j = np.nonzero(rough >= (least - margin)[:, None])
        score = np.einsum("ij,ij->i", some[i], vectors[j])
        order = np.lexsort([ids[j], -score, i])
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        found.append((i[rank < k] + start, j[rank < k], score[rank < k]))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _true_neighbours(
    vectors: DataFrame, queries: np.ndarray, own: np.ndarray, k: int, dims: int
) -> DataFrame:
    """The k best vectors of each of a few queries, with one scan of all vectors."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_ROWS):
                part = batch.slice(start, TILE_ROWS)
                ids = part.column("id").to_numpy()
                i, j, scores = _top(queries, dense(part.column("v"), dims), ids, k + 1)
                other = ids[j] != own[i]
                i, j, scores = i[other], j[other], scores[other]
                columns = [pa.array(i), part.column("id").take(pa.array(j)), pa.array(scores)]
                columns.append(part.column("v").take(pa.array(j)))
                yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "score", "v"])

    kind = vectors.schema["v"].dataType.simpleString()
    found = vectors.mapInArrow(score, f"query long, id long, score double, v {kind}")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def fit_hashing(
    vectors: DataFrame, queries: DataFrame, k: int, *, dims: int, longest: float, rows: int,
    target: float = TARGET,
) -> Hashing:
    """Hashing whose visits find ``target`` of the true neighbours of a query sample.

    The sample has at most ``SAMPLE_QUERIES`` queries, chosen by a hash of their id.
    Tables start with as many projections as the rows allow and get fewer, hence
    larger buckets, until ``MAX_PROBES`` visits suffice.
    """
    chosen = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_QUERIES).toArrow()
    asked = dense(chosen.column("v").combine_chunks(), dims)
    own = chosen.column("id").to_numpy()
    truth = _true_neighbours(vectors, asked, own, k, dims).select("query", "v").toArrow()
    if not truth.num_rows:
        return Hashing.draw(lifted(asked, longest), 1)
    owner = truth.column("query").to_numpy()
    near, points = lifted(dense(truth.column("v").combine_chunks(), dims), longest), levelled(asked)
    likeness = float(np.mean(np.einsum("ij,ij->i", points[owner], near)))
    start = int(np.log(max(rows / BUCKET_ROWS, 1)) / np.log(SLOTS_IN_USE))
    for projections in range(min(max(start, 1), MAX_PROJECTIONS), 0, -1):
        hashing = Hashing.draw(near, projections)
        hashing.likeness = likeness
        needed = np.sort(probes_needed(hashing, points, near, owner))
        hashing.probes = int(needed[int(np.ceil(target * len(needed))) - 1])
        if hashing.probes <= MAX_PROBES:
            return hashing
    hashing.probes = len(perturbations(1))
    return hashing


def _placed(rows: DataFrame, hashing: Hashing, dims: int, longest: float, query: bool,
            with_vectors: bool) -> DataFrame:
    """Every vector in its bucket of each table, or every query in those it visits."""
    steps = perturbations(hashing.projections)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS if query else TILE_ROWS):
                part = batch.slice(start, SLICE_ROWS if query else TILE_ROWS)
                matrix = dense(part.column("v"), dims)
                points = levelled(matrix) if query else lifted(matrix, longest)
                slots = None if query else hashing.slots(points)
                for table, columns in enumerate(hashing.tables):
                    if query:
                        found = hashing.visits(points, table, steps)
                    else:
                        found = hashing.buckets(slots[:, columns], table)[:, None]
                    at = pa.array(np.repeat(np.arange(len(found)), found.shape[1]))
                    bucket = pa.array(found.ravel())
                    taken = [part.column(c).take(at) for c in names[1:]]
                    yield pa.RecordBatch.from_arrays([bucket, *taken], names=names)

    names = ["bucket", "id", "v"] if with_vectors else ["bucket", "id"]
    schema = "bucket long, id long"
    if with_vectors:
        schema += f", v {rows.schema['v'].dataType.simpleString()}"
    return rows.mapInArrow(place, schema)


def _score_tile(tile: pa.Table, k: int, dims: int) -> pa.Table:
    asks = tile.column("asks").to_numpy()
    ids = tile.column("id").to_numpy()
    matrix = dense(tile.column("v").combine_chunks(), dims)
    q, v = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(q) or not len(v):
        return pa.table(dict(zip(("query", "id", "score"), [[], [], []])), FOUND_ARROW)
    i, j, score = _top(matrix[q], matrix[v], ids[v], k)
    return pa.table([ids[q[i]], ids[v[j]], score], FOUND_ARROW)


FOUND_ARROW = pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
FOUND = "query long, id long, score double"


def _tiles(vectors: DataFrame, queries: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of both sides in the tiles of their bucket.

    A bucket has a tile for each part of its vectors and each part of its queries; a
    row belongs to one part of its own side and meets all parts of the other.
    """
    sides = []
    for rows, asks, own, other in ((vectors, False, "p", "q"), (queries, True, "q", "p")):
        mine = F.pmod(F.xxhash64("id"), F.col(f"parts_{own}")).cast("int").alias(own)
        rest = F.explode(F.sequence(F.lit(0), F.col(f"parts_{other}") - 1)).alias(other)
        met = rows.join(sizes, "bucket").select("bucket", "id", "v", mine, rest)
        sides.append(met.withColumn("asks", F.lit(asks)))
    return sides[0].unionByName(sides[1])


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    *,
    scratch: Scratch,
    target: float = TARGET,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """The k vectors of largest inner product found for each query row, best first.

    ``query_id``, ``rank`` from 1, ``vec_id`` and ``score``, the inner product in
    double precision. ``is_query`` tells the rows that ask; all rows but those of the
    query's own id are searched. Ties go to the smaller id, and a query has fewer
    than k rows only where there are fewer candidates or its buckets hold fewer.

    Null vectors, zero vectors and those with null or non-finite components take no
    part, nor do rows without an id. Rows that repeat id and vector count once. Of
    equal vectors the k + 1 smallest ids are searched, since no others can be among
    the k best. Shorter vectors count as filled with zeros. An empty table, or one
    without queries, gives an empty result; other columns are ignored.
    """
    rows = vectors.select(
        named(id_column).cast("long").alias("id"),
        named(vector_column).alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(F.col("id").isNotNull() & usable(F.col("v")))
    square = F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")
    )
    single = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    single = scratch.stage(single, "vectors")
    asking = single.filter("asks").select("id", "v")
    facts = single.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    empty = asking.select(
        F.col("id").alias("query_id"), F.lit(0).alias("rank"),
        F.col("id").alias("vec_id"), F.lit(0.0).alias("score"),
    ).filter("false")
    if not facts[0]:
        return empty
    n_rows, dims, longest = int(facts[0]), int(facts[1]), float(np.sqrt(facts[2]))

    copies = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    index = single.select("id", "v", copies.alias("copy")).filter(F.col("copy") <= k + 1)
    index = scratch.stage(index.select("id", "v"), "index")
    # Queries with equal vectors have equal neighbours, but for themselves.
    first = scratch.stage(asking.groupBy("v").agg(F.min("id").alias("id")), "queries")
    if first.isEmpty():
        return empty
    hashing = fit_hashing(
        index, first.select("id", "v"), k, dims=dims, longest=longest, rows=n_rows, target=target
    )

    def placed(query: bool, with_vectors: bool) -> DataFrame:
        return _placed(first.select("id", "v") if query else index, hashing, dims, longest, query,
                       with_vectors)

    counts = [
        placed(query, False).groupBy("bucket").agg(F.count("*").alias(name))
        for query, name in ((False, "n_p"), (True, "n_q"))
    ]
    sizes = counts[0].join(counts[1], "bucket").select(
        "bucket",
        *[F.ceil(F.col(f"n_{s}") / TILE_ROWS).cast("int").alias(f"parts_{s}") for s in "pq"],
    )
    sizes = scratch.stage(sizes, "bucket-sizes")
    tiles = _tiles(placed(False, True), placed(True, True), sizes)
    found = tiles.groupBy("bucket", "p", "q").applyInArrow(
        lambda tile: _score_tile(tile, k + 1, dims), FOUND
    )
    # A table's finds repeat those of another; scores of the same pair are the same.
    merged = scratch.stage(found, "finds").groupBy("query", "id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    merged = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)
    lists = merged.groupBy("query").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "id"))).alias("found")
    )
    answers = first.select("v", F.col("id").alias("query")).join(lists, "query")
    answers = scratch.stage(answers.select("v", "found"), "answers")
    answered = join_lookup(asking, answers, ["v"], scratch=scratch, how="inner")
    others = F.filter("found", lambda x: x["id"] != F.col("id"))
    ranked = answered.select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("at", "one")
    )
    return ranked.select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("one.id").alias("vec_id"),
        (-F.col("one.far")).alias("score"),
    )
