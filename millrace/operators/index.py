"""The chunk index: merge, delta sync, queries, and the vectors that hang on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lookups import HOT_ROWS, join_lookup
from millrace.operators.merge import insert_absent, merge_rows
from millrace.operators.shape import where_equal
from millrace.scratch import Scratch


def index_rows(chunks: DataFrame, run_id: str) -> DataFrame:
    """Chunks in the layout of the index, stamped with the run and the time."""
    # The names of the stored columns.
    return chunks.select(
        "chunk_id",
        "doc_id",
        "semantic_id",
        "source_table",
        "source_pk",
        "chunk_index",
        "chunk_text",
        "title",
        F.col("metadata").alias("metadata_json"),
        F.to_json("tags").alias("tags_json"),
        "char_count",
        F.lit(run_id).alias("run_id"),
        F.current_timestamp().alias("indexed_at"),
    )


def merge_index(stored: DataFrame, new: DataFrame, *, replace_existing: bool = True) -> DataFrame:
    """Merge by chunk id: new rows replace stored ones, or stored ones are kept."""
    if replace_existing:
        return merge_rows(stored, new, ["chunk_id"])
    return insert_absent(stored, new, ["chunk_id"])


def obsolete_chunks(stored: DataFrame, new: DataFrame, semantic_id: str) -> DataFrame:
    """Stored chunks of the semantic id that the new set no longer has."""
    own = stored.filter(F.col("semantic_id") == semantic_id)
    return own.join(new.select("chunk_id"), "chunk_id", "left_anti").select(*stored.columns)


def sync_index(
    stored: DataFrame, new: DataFrame, semantic_id: str, *, replace_existing: bool = True
) -> DataFrame:
    """Index after a delta sync of one semantic id; others stay as they are.

    With replacement the new set simply becomes the content of the semantic id:
    obsolete rows go, all others are overwritten. Only keeping stored rows needs
    a join.
    """
    new = new.select(*stored.columns)
    others = stored.filter(F.col("semantic_id") != semantic_id)
    if replace_existing:
        return others.unionByName(new)
    own = stored.filter(F.col("semantic_id") == semantic_id)
    kept = own.join(new.select("chunk_id"), "chunk_id", "left_semi")
    return others.unionByName(insert_absent(kept, new, ["chunk_id"]))


def query_chunks(
    index: DataFrame,
    *,
    semantic_id: str | None = None,
    source_table: str | None = None,
    run_id: str | None = None,
    limit: int | None = 100,
) -> DataFrame:
    """Chunks that meet the given conditions, by semantic id, document and position."""
    found = where_equal(index, semantic_id=semantic_id, source_table=source_table, run_id=run_id)
    found = found.orderBy("semantic_id", "doc_id", "chunk_index")
    return found if limit is None else found.limit(limit)


def get_chunk(index: DataFrame, chunk_id: str) -> DataFrame:
    return index.filter(F.col("chunk_id") == chunk_id)


def cascade_vectors(vectors: DataFrame, index: DataFrame, *, on: str = "chunk_id") -> DataFrame:
    """Vectors whose chunk is still in the index."""
    return vectors.join(index.select(on), on, "left_semi").select(*vectors.columns)


def vector_sources(
    vectors: DataFrame,
    source: DataFrame,
    *,
    source_id: str,
    vector_ref: str = "source_row_id",
    scratch: Scratch,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Vectors with the row they came from. Many vectors may share one source row."""
    lookup = source.withColumnRenamed(source_id, vector_ref)
    return join_lookup(
        vectors, lookup, [vector_ref], scratch=scratch, how="inner", hot_rows=hot_rows
    )


# Query vectors that every task may hold at once, as numbers.
RESIDENT_FLOATS = 4_000_000

# Queries of a block, and scores a task holds at a time.
BLOCK_QUERIES = 2_048
SLICE_SCORES = 8_000_000

# Numbers of the blocks that one task holds, its winners included.
HELD_FLOATS = 4_000_000

# Bytes of vectors that meet a group of blocks in one task.
CELL_BYTES = 256 * 1024 * 1024

# Parts that the winners of all tasks are first reduced in.
WINNER_PARTS = 64


def nearest_vectors(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    scratch: Scratch,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    query_id_column: str = "query_id",
    query_vector_column: str = "embedding",
    resident_floats: int = RESIDENT_FLOATS,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """Exact cosine top-k of the vectors for each row of ``queries``; ties go to the smaller id.

    Tasks score batches of vectors against blocks of queries as matrix products and keep
    a heap of k rows per query, so what they pass on is k rows per query and task, never
    a list of pairs; heaps are merged in two steps. Queries that are few by count go to
    all tasks, and the vectors stay where they are. More of them are dealt into groups of
    blocks, as many as a task may hold, and every group meets every part of the vectors in
    a task of its own, where the vectors stream past the blocks; neither side passes
    through the driver.

    Ids are whole numbers or texts, those of queries unique. Null vectors and scores that
    are no finite numbers are left out; a zero vector scores 0. All vectors have the same
    length.
    """
    asked = scratch.stage(
        queries.select(
            F.col(query_id_column).alias("query_id"), F.col(query_vector_column).alias("v")
        ).filter("query_id IS NOT NULL AND v IS NOT NULL"),
        "queries",
    )
    found = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
    found = found.filter("v IS NOT NULL")
    facts = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("width"))
    n, width = facts.first()
    if n * width <= max(resident_floats, 0):
        winners = _resident_winners(found, asked, k)
    else:
        tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        groups, parts = grid_shape(tasks, n, vectors.count(), width, k, block_queries)
        winners = _grid_winners(found, asked, k, groups, parts, block_queries)
    winners = winners.withColumn("part", F.spark_partition_id() % WINNER_PARTS)
    for keys in (["query_id", "part"], ["query_id"]):
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
        winners = winners.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return winners.select("query_id", F.col("id").alias(id_column), "score", "rank")


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of a matrix; a null component is no number."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1)


def _units(matrix: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(length == 0, 1.0, length)[:, None]


class _Heaps:
    """The k best vectors so far for each query of a block."""

    def __init__(self, query_ids: pa.Array, matrix: np.ndarray, k: int) -> None:
        self.query_ids, self.k = query_ids, k
        self.queries = _units(matrix)
        self.least = np.full(len(matrix), -np.inf)
        self.best = pd.DataFrame({"query": [], "id": [], "score": []})

    def offer(self, ids: pa.Array, units: np.ndarray) -> None:
        """Let vectors of length one, or zero, compete."""
        step = max(1, SLICE_SCORES // max(len(self.queries), 1))
        for start in range(0, len(units), step):
            self._offer(ids.slice(start, step), units[start : start + step])

    def _offer(self, ids: pa.Array, vectors: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            scores = self.queries @ vectors.T
        # The product rounds as its shape has it; what may win is scored once more alone.
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        least = self.least
        if scores.shape[1] > self.k:
            at = scores.shape[1] - self.k
            least = np.maximum(least, np.partition(scores, at, axis=1)[:, at])
        i, j = np.nonzero((scores >= (least - 1e-9)[:, None]) & (scores > -np.inf))
        if not len(i):
            return
        new = pd.DataFrame(
            {
                "query": i,
                "id": ids.take(pa.array(j)).to_pandas(),
                "score": np.einsum("ij,ij->i", self.queries[i], vectors[j]),
            }
        )
        both = pd.concat([self.best, new]) if len(self.best) else new
        both = both.sort_values(["query", "score", "id"], ascending=[True, False, True])
        self.best = both.groupby("query").head(self.k)
        full = self.best.groupby("query")["score"].agg(["size", "min"])
        full = full[full["size"] == self.k]
        self.least[full.index.to_numpy(np.int64)] = full["min"].to_numpy()

    def winners(self) -> Iterator[pa.RecordBatch]:
        if len(self.best):
            query = self.query_ids.take(pa.array(self.best["query"].to_numpy(np.int64)))
            ids = pa.array(self.best["id"].tolist())
            score = pa.array(self.best["score"].to_numpy(np.float64))
            yield pa.RecordBatch.from_arrays([query, ids, score], names=["query_id", "id", "score"])


def _winner_schema(vectors: DataFrame, queries: DataFrame) -> str:
    kinds = queries.schema["query_id"].dataType, vectors.schema["id"].dataType
    return "query_id {}, id {}, score double".format(*[t.simpleString() for t in kinds])


def _resident_winners(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Winners of each task for queries that all tasks hold; their size is checked."""
    asked = queries.toArrow()
    query_ids = asked.column("query_id").combine_chunks()
    block = _matrix(asked.column("v").combine_chunks()) if len(query_ids) else np.zeros((0, 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = _Heaps(query_ids, block, k)
        for batch in batches:
            if batch.num_rows and len(query_ids):
                heaps.offer(batch.column("id"), _units(_matrix(batch.column("v"))))
        yield from heaps.winners()

    return vectors.mapInArrow(score, _winner_schema(vectors, queries))


def grid_shape(
    tasks: int, n_queries: int, n_vectors: int, width: int, k: int, block_queries: int
) -> tuple[int, int]:
    """Groups of query blocks and parts of the vectors: the sides of the grid of tasks.

    Vectors are moved once per group and queries once per part, so the sides are taken
    where both together are least. A group is one block at least, and no more blocks than
    a task may hold.
    """
    blocks = -(-n_queries // block_queries)
    held = max(1, HELD_FLOATS // (block_queries * (width + 8 * k)))
    least = -(-blocks // held)
    even = round((tasks * n_queries / max(n_vectors, 1)) ** 0.5)
    groups = max(1, min(blocks, max(least, even)))
    tasks = max(tasks, 8 * n_vectors * width * groups // CELL_BYTES)
    return groups, -(-tasks // groups)


def _grid_winners(
    vectors: DataFrame, queries: DataFrame, k: int, groups: int, parts: int, block_queries: int
) -> DataFrame:
    """Winners of a grid of tasks, each a group of query blocks by a part of the vectors.

    In a task the queries of its group come first and the vectors follow, by a sort that
    spills, so that a task holds one group and one batch of vectors.
    """

    def dealt(column: str, count: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(count))

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    left = queries.select(
        "query_id", "v", dealt("query_id", groups).alias("group"), each(parts).alias("part")
    )
    right = vectors.select("id", "v", dealt("id", parts).alias("part"), each(groups).alias("group"))
    if left.schema["v"].dataType != right.schema["v"].dataType:
        left, right = [side.withColumn("v", F.col("v").cast("array<double>")) for side in (left, right)]
    both = left.withColumn("side", F.lit(0)).unionByName(
        right.withColumn("side", F.lit(1)), allowMissingColumns=True
    )
    both = both.withColumn("cell", F.col("group") * parts + F.col("part"))
    both = both.select("cell", "side", "query_id", "id", "v")
    both = both.repartition(groups * parts, "cell").sortWithinPartitions("cell", "side")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, waiting, blocks = None, [], []
        for batch in batches:
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            changes = np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1
            edges = [0, *changes.tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:]):
                run = batch.slice(start, end - start)
                if end == start:
                    continue
                if cells[start] != cell:
                    for heaps in blocks:
                        yield from heaps.winners()
                    cell, waiting, blocks = cells[start], [], []
                if sides[start] == 0:
                    waiting.append(run)
                    continue
                if waiting:
                    table = pa.Table.from_batches(waiting)
                    for at in range(0, table.num_rows, block_queries):
                        some = table.slice(at, block_queries)
                        asked = some.column("query_id").combine_chunks()
                        blocks.append(_Heaps(asked, _matrix(some.column("v").combine_chunks()), k))
                    waiting = []
                if blocks:
                    units = _units(_matrix(run.column("v")))
                    for heaps in blocks:
                        heaps.offer(run.column("id"), units)
        for heaps in blocks:
            yield from heaps.winners()

    return both.mapInArrow(score, _winner_schema(vectors, queries))
