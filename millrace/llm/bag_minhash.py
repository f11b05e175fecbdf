"""Near duplicates by weighted MinHash of word shingles (BagMinHash).

A text is the multiset of its shingles of five words; its similarity to another is the
weighted Jaccard index, shared shingles with multiplicity over all of them. The weight
of a shingle is cut into strata [0, 1), [1, 2), [2, 4), [4, 8) and so on. In each a
Poisson process, seeded by shingle and stratum, emits points with a time, a component
of the signature and a weight; points whose weight lies below the shingle's own count.
The earliest point of a component is its signature, and two texts agree there with the
probability of their similarity. Points later than what fills a signature are never
made. Signatures are cut into bands; texts with a band in common are compared exactly.

Texts with the same words collapse first. Within a band's bucket, which may be large,
texts are compared with a pivot, texts linked so are one component, and a few rounds
with further pivots link what the first one missed. Pairs still in different components
are compared tile by tile: a task counts what the texts of two bounded blocks have in
common and reports a spanning forest of the links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, named, text_of
from millrace.llm.components import connected_components, smallest_reachable
from millrace.scratch import Scratch

SHINGLE_WORDS = 5
COMPONENTS = 128
BAND_ROWS = 4

# Pivot rounds go on while exhaustion would cost more comparisons per member than
# COMPARISONS, as long as a round saves at least SAVING of that cost.
COMPARISONS = 128
SAVING = 0.05

# Texts and shingles of one side of a tile, and numbers a task counts with at a time.
TILE_ROWS = 1_024
TILE_SHINGLES = 1 << 19
COUNTED = 1 << 22

# Shingles that at least one of so many pairs of a tile share are counted by a matrix
# product, the others pair by pair.
DENSE = 64

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SLICE = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers, one to one."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _scaled(number: int) -> np.uint64:
    return np.uint64(number * int(_STEP) & 0xFFFFFFFFFFFFFFFF)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, lower case, and each text's count."""
    texts = pc.utf8_lower(texts.cast(pa.large_string()))
    for blank in "\n\t\r\v\f":
        texts = pc.replace_substring(texts, blank, " ")
    lists = pc.split_pattern(texts, " ")
    bounds = lists.offsets.to_numpy()
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    real = np.array([bool(word) for word in words], bool)
    codes = coded.indices.to_numpy()
    there = real[codes] if len(codes) else np.zeros(0, bool)
    reached = np.concatenate([[0], np.cumsum(there)])[bounds - bounds[0]]
    return hashes[codes[there]], np.diff(reached)


def sequence_hashes(words: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """128 bits of each text's sequence of words."""
    ends = np.cumsum(counts)
    place = np.arange(len(words)) - np.repeat(ends - counts, counts)
    where = mix(place.astype(np.uint64) + _STEP)
    halves = []
    for salt in (1, 2):
        spread = mix(words ^ mix(where + np.uint64(salt)))
        total = np.concatenate([[np.uint64(0)], np.cumsum(spread, dtype=np.uint64)])
        halves.append(total[ends] - total[ends - counts])
    both = np.stack([*halves, counts.astype(np.uint64)], 1)
    return [row.tobytes() for row in both]


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and their text; a shorter text is one run."""
    ends = np.cumsum(counts)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), sizes)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes - (ends - counts), sizes)
    total = np.zeros(len(owner), np.uint64)
    for j in range(k):
        at = first + j
        inside = at < ends[owner]
        word = np.where(inside, words[np.minimum(at, max(len(words) - 1, 0))], np.uint64(j + 1))
        total = mix(total * _STEP + word)
    return total, owner


def multiset(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct shingles by text with their multiplicity, and for each occurrence its
    number among the equal ones."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    weights = np.diff(np.append(first, len(values)))
    number = np.arange(len(values)) - np.repeat(first, weights)
    return values[first], owner[first], weights, values, owner, number


def signatures(
    values: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, m: int = COMPONENTS
) -> np.ndarray:
    """``n`` signatures of ``m`` components; rows of texts without shingles are zero."""
    found = np.zeros((n, m), np.uint64)
    total = np.bincount(owner, weights, n)
    todo = total > 0
    limit = m * (np.log(m) + 3) / np.maximum(total, 1)
    while todo.any():
        pick = todo[owner]
        best = np.full(n * m, np.inf)
        mark = np.zeros(n * m, np.uint64)
        _points(values[pick], owner[pick], weights[pick], limit, m, best, mark)
        filled = np.isfinite(best.reshape(n, m)).all(1)
        done = todo & filled
        found[done] = mark.reshape(n, m)[done]
        todo &= ~filled
        limit = limit * 2
    return found


def _points(values, owner, weights, limit, m, best, mark) -> None:
    """Earliest points by text and component up to each text's time limit."""
    for stratum in range(int(weights.max()).bit_length() + 1):
        low = 0 if stratum == 0 else 1 << (stratum - 1)
        rate = max(low, 1)
        in_it = weights > low
        if not in_it.any():
            return
        seed = mix(values[in_it] + _scaled(stratum))
        text, weight = owner[in_it], weights[in_it]
        time, number = np.zeros(len(seed)), 0
        while len(seed):
            number += 1
            draw = mix(seed + _scaled(number))
            time = time - np.log(((draw >> np.uint64(11)) + np.uint64(1)) / 2.0**53) / rate
            early = time <= limit[text]
            seed, text, weight, time, draw = (x[early] for x in (seed, text, weight, time, draw))
            more = mix(draw ^ _STEP)
            counts = low + rate * ((more >> np.uint64(40)) / 2.0**24) < weight
            place = text[counts] * m + (more[counts] % np.uint64(m)).astype(np.int64)
            when = time[counts]
            np.minimum.at(best, place, when)
            first = best[place] == when
            mark[place[first]] = draw[counts][first]


def band_hashes(signature: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    bands = signature.reshape(len(signature), -1, rows)
    total = np.zeros(bands.shape[:2], np.uint64)
    for j in range(rows):
        total = mix(total * _STEP + bands[:, :, j])
    return total.view(np.int64)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The values of each of ``n`` owners, whose numbers ascend, as one list."""
    bounds = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in byte_slices(batch, "text", _SLICE):
            words, counts = word_hashes(piece.column("text"))
            distinct, owner, weights, *_ = multiset(*shingles(words, counts, k))
            signed = band_hashes(signatures(distinct, owner, weights, len(piece)))
            bands = pa.array(signed.ravel())
            bounds = pa.array(np.arange(len(piece) + 1) * signed.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"),
                    piece.column("text_key"),
                    pa.array(sequence_hashes(words, counts), pa.binary()),
                    pa.array(counts > 0),
                    pa.ListArray.from_arrays(bounds, bands),
                ],
                names=["doc_id", "text_key", "words", "any", "bands"],
            )


def _shingle_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in byte_slices(batch, "text", _SLICE):
            words, counts = word_hashes(piece.column("text"))
            *_, values, owner, number = multiset(*shingles(words, counts, k))
            coded = mix(values + mix(number.astype(np.uint64) + _STEP))
            same = pa.array(
                [a == b for a, b in zip(sequence_hashes(words, counts), piece.column("words").to_pylist())],
                pa.bool_(),
            )
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("node"),
                    piece.column("pivot"),
                    _lists(coded, owner, len(piece)),
                ],
                names=["node", "pivot", "shingles"],
            ).filter(same)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left shares with each on the right."""
    n, m = len(left), len(right)
    total = np.zeros(n * m)
    codes = np.concatenate([*left, *right])
    if not len(codes):
        return total.reshape(n, m)
    owner = np.repeat(np.arange(n + m), [len(s) for s in (*left, *right)])
    # Of equal values those on the left come first.
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    new = np.append(True, codes[1:] != codes[:-1])
    first, column = np.flatnonzero(new), np.cumsum(new) - 1
    on_left = owner < n
    n_left = np.bincount(column[on_left], minlength=len(first))
    n_right = np.diff(np.append(first, len(codes))) - n_left
    often = n_left * n_right * DENSE > n * m
    place = np.where(often, np.cumsum(often) - 1, -1)[column]
    width = max(1, COUNTED // (n + m))
    for start in range(0, int(often.sum()), width):
        inside = (place >= start) & (place < start + width)
        cells = np.zeros((n + m, min(width, int(often.sum()) - start)), np.float32)
        cells[owner[inside], place[inside] - start] = 1
        total += (cells[:n] @ cells[n:].T).ravel()
    some = np.flatnonzero(on_left & ~often[column] & (n_right[column] > 0))
    partners = n_right[column[some]]
    begin = (first + n_left)[column[some]]
    ends = np.cumsum(partners)
    steps = np.arange(COUNTED, ends[-1] + COUNTED, COUNTED) if len(some) else np.zeros(0)
    at = 0
    for stop in np.searchsorted(ends, steps, side="right"):
        stop = max(stop, min(at + 1, len(some)))
        size = partners[at:stop]
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        there = owner[np.repeat(begin[at:stop], size) + inner] - n
        here = np.repeat(owner[some[at:stop]], size)
        total += np.bincount(here * m + there, minlength=n * m)
        at = stop
    return total.reshape(n, m)


def tile_forest(tile: pa.Table, limit: float) -> pa.Table:
    """Edges ``a``, ``b`` that connect what the links of a tile connect.

    A tile holds the texts that met at one centre, or at several whole ones. Those on
    the left are compared with those on the right of other components.
    """
    centre, node, root, main, on_left = (
        tile.column(c).to_numpy() for c in ("a", "node", "root", "main", "left")
    )
    lists = tile.column("shingles").combine_chunks()
    cells = np.split(lists.values.to_numpy(), lists.offsets.to_numpy())[1:]
    order = np.argsort(centre, kind="stable")
    bounds = np.flatnonzero(np.append(True, np.diff(centre[order]) != 0))
    low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows in np.split(order, bounds[1:]):
        left, right = rows[on_left[rows]], rows[~on_left[rows]]
        if not len(left) or not len(right):
            continue
        sets = [[cells[i] for i in side] for side in (left, right)]
        shared = common_counts(*sets)
        n_left, n_right = (np.array([len(x) for x in side]) for side in sets)
        # Two texts outside the main component meet twice, but count once.
        once = main[right] | (node[left][:, None] < node[right])
        close = shared / (n_left[:, None] + n_right - shared) >= limit
        i, j = np.nonzero(close & once & (root[left][:, None] != root[right]))
        if not len(i):
            continue
        nodes, number = np.unique(node[np.concatenate([left[i], right[j]])], return_inverse=True)
        reached = nodes[smallest_reachable(len(nodes), number[: len(i)], number[len(i) :])]
        low.append(reached[reached != nodes])
        high.append(nodes[reached != nodes])
    return pa.table({"a": np.concatenate(high), "b": np.concatenate(low)})


class _Buckets:
    """Candidate pairs of one run and the links found among them."""

    def __init__(self, members: DataFrame, sets: DataFrame, limit: float, scratch: Scratch) -> None:
        self.members, self.sets, self.limit, self.scratch = members, sets, limit, scratch

    def measure(self, pairs: DataFrame, sets_a: DataFrame, label: str) -> DataFrame:
        """Exact similarity of pairs ``a``, ``b``."""
        right = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
        left = sets_a.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
        shared = F.size(F.array_intersect("sa", "sb"))
        similarity = shared / (F.size("sa") + F.size("sb") - shared)
        found = pairs.join(right, "b").join(left, "a").select(
            "a", "b", similarity.alias("similarity")
        )
        return self.scratch.stage(found, label)

    def similar(self, measured: DataFrame) -> DataFrame:
        return measured.filter(F.col("similarity") >= self.limit).select("a", "b")

    def components(self, links: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
        """Components of the earlier ones and the links found now."""
        if earlier is not None:
            if links.isEmpty():
                return earlier
            stars = earlier.select(F.col("node").alias("a"), F.col("component").alias("b"))
            links = links.unionByName(stars)
        found = connected_components(links, self.scratch)
        return self.scratch.stage(found, "components")

    def open_members(self, components: DataFrame) -> DataFrame:
        """Members of buckets that still hold several components.

        The two texts of a bucket of two were compared as pivot and member.
        """
        placed = self.members.join(
            components.withColumnRenamed("component", "root"), "node", "left"
        ).withColumn("root", F.coalesce("root", "node"))
        mixed = placed.groupBy("pivot").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")
        )
        mixed = self.scratch.stage(mixed.filter("low < high AND n > 2").select("pivot"), "mixed")
        return self.scratch.stage(placed.join(mixed, "pivot", "left_semi"), "open")

    def largest(self, open_: DataFrame, number: int) -> DataFrame:
        """The largest component of each bucket, one of its texts, and the comparisons
        of all others with the whole bucket.

        The text is first the one closest to the bucket's pivot, for where copies of
        one text meet it is closest to all of them; later it is any.
        """
        first = F.when(F.col("far") > 0, F.col("far")) if number == 0 else F.lit(0.0)
        first = F.coalesce(first, F.lit(2.0))
        order = F.struct(first, F.xxhash64(F.lit(number), "node"), "node")
        sizes = open_.groupBy("pivot", "root").agg(
            F.count("*").alias("n"), F.min(order).alias("c")
        )
        main = F.max(F.struct("n", "root", "c.node")).alias("l")
        found = sizes.groupBy("pivot").agg(main, F.sum("n").alias("all"))
        found = found.select(
            "pivot", F.col("l.root").alias("main"), F.col("l.node").alias("a"),
            ((F.col("all") - F.col("l.n")) * F.col("all")).alias("cost"),
        )
        return self.scratch.stage(found, "largest")

    def links_by_tiles(self, open_: DataFrame, largest: DataFrame) -> DataFrame:
        """Links between different components within buckets, as spanning forests.

        Texts that met at one centre, a text of their bucket's largest component, are
        dealt into blocks of bounded size, those outside that component on the left and
        all on the right. Centres of one block a side share tasks.
        """
        near = open_.join(largest.select("pivot", "a", "main"), "pivot")
        near = near.select("a", "node", "root", (F.col("root") == F.col("main")).alias("main"))
        near = near.distinct().join(self.sets.select("node", "shingles"), "node")
        near = self.scratch.stage(near, "near")
        n_shingles = F.size("shingles")

        def blocks(these: Column) -> Column:
            by_shingles = F.ceil(F.sum(F.when(these, n_shingles).otherwise(0)) / TILE_SHINGLES)
            by_rows = F.ceil(F.count_if(these) / TILE_ROWS)
            return F.greatest(by_shingles, by_rows).cast("int")

        centres = near.groupBy("a").agg(
            blocks(~F.col("main")).alias("n_left"), blocks(F.lit(True)).alias("n_right"),
            F.sum(n_shingles).alias("size"), F.count("*").alias("rows"),
        )
        centres = self.scratch.stage(centres.filter("n_left > 0"), "centres")
        single = (F.col("n_left") == 1) & (F.col("n_right") == 1)
        tasks = F.greatest(F.sum("size") / TILE_SHINGLES, F.sum("rows") / (8 * TILE_ROWS))
        packs = int(centres.filter(single).agg(tasks).first()[0] or 0) + 1
        pack = F.when(single, F.pmod(F.xxhash64("a"), F.lit(packs)) - packs).otherwise(F.col("a"))
        dealt = near.join(centres.select("a", "n_left", "n_right", pack.alias("pack")), "a")
        block = [F.pmod(F.xxhash64("node"), F.col(n)).cast("int") for n in ("n_left", "n_right")]
        all_blocks = [
            F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("n_left", "n_right")
        ]
        columns = ["pack", "a", "node", "root", "main", "shingles"]
        tiles = dealt.filter("not main").select(
            *columns, F.lit(True).alias("left"), block[0].alias("p"), all_blocks[1].alias("q")
        ).unionByName(
            dealt.select(
                *columns, F.lit(False).alias("left"), all_blocks[0].alias("p"), block[1].alias("q")
            )
        )
        limit = self.limit
        found = tiles.groupBy("pack", "p", "q").applyInArrow(
            lambda tile: tile_forest(tile, limit), "a long, b long"
        )
        return self.scratch.stage(found, "links-by-tiles")


def _link(texts: DataFrame, docs: DataFrame, limit: float, k: int, scratch: Scratch) -> DataFrame:
    """Components of the texts, each by its number."""
    rows = texts.filter("any").select("node", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("node").alias("pivot"))
    buckets = scratch.stage(buckets.filter("n > 1").select("band", "key", "pivot"), "buckets")
    # Texts that share a bucket share its pivot, so all buckets of a pivot are taken as one.
    members = rows.join(buckets, ["band", "key"]).select("pivot", "node").distinct()
    members = scratch.stage(members, "members")
    first = members.filter("node != pivot")
    first = first.select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    used = first.select(F.col("b").alias("node"), F.lit(0).alias("p")).unionByName(
        first.select(F.col("a").alias("node"), F.lit(1).alias("p"))
    )
    used = used.groupBy("node").agg((F.max("p") == 1).alias("pivot"))
    wanted = texts.select("node", "rep", "rep_key", "words").join(used, "node")
    wanted = scratch.stage(wanted, "wanted")
    # The key of the text keeps rows without an id, or of one id, from meeting all others.
    same = F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_key") == F.col("rep_key"))
    source = docs.join(wanted.hint("merge"), same).select("node", "pivot", "words", "text")
    sets = source.mapInArrow(
        lambda b: _shingle_sets(b, k), "node long, pivot boolean, shingles array<long>"
    )
    sets = scratch.stage(sets, "shingle-sets")
    if sets.count() > wanted.count():
        # Rows that repeat an id and a text bring the same set again.
        sets = scratch.stage(sets.dropDuplicates(["node"]), "distinct-sets")
    run = _Buckets(members, sets, limit, scratch)
    # Staged, so that adaptive execution can split the join of a hot pivot.
    pivots = scratch.stage(sets.filter("pivot").dropDuplicates(["node"]), "pivot-sets")
    measured = run.measure(first, pivots, "similarities-0")
    components = run.components(run.similar(measured))
    distance = measured.select(
        F.col("a").alias("pivot"), F.col("b").alias("node"), (1 - F.col("similarity")).alias("far")
    )
    placed = members.join(distance, ["pivot", "node"], "left").fillna(0.0, ["far"])
    run.members = scratch.stage(placed, "members-far")
    number, before = 0, float("inf")
    while True:
        open_ = run.open_members(components)
        largest = run.largest(open_, number)
        cost = largest.agg(F.coalesce(F.sum("cost"), F.lit(0))).first()[0]
        if cost <= COMPARISONS * open_.count() or cost > (1 - SAVING) * before:
            break
        number, before = number + 1, cost
        # Another pivot out of each bucket's largest component, for all the others.
        pairs = open_.join(largest, "pivot").filter("root != main")
        pairs = pairs.select("a", F.col("node").alias("b")).distinct()
        found = run.measure(scratch.stage(pairs, "pairs"), sets, f"similarities-{number}")
        components = run.components(run.similar(found), components)
    if open_.isEmpty():
        return components
    return run.components(run.links_by_tiles(open_, largest), components)


def near_duplicates(
    docs: DataFrame,
    *,
    scratch: Scratch,
    similarity: float = 0.8,
    shingle_words: int = SHINGLE_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per input row: ``doc_id``, ``text_key`` (md5 of its text), ``class_id``
    (smallest id of its class) and ``kept`` (whether it is that one).

    Classes are the components of links between texts of ``similarity`` or more. Words
    are lower case and part at blanks. Texts of the same words are one class, texts
    without words (null, empty, blank) too. A text of fewer words than a shingle is one
    shingle. A null id is never the smallest unless a class has no other; rows that
    share an id and a text are decided alike. An empty table gives an empty result;
    other columns are ignored.

    Texts of that similarity share no band, and so may stay unlinked, with a
    probability below 1e-7.
    """
    rows = docs.select(
        named(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text")
    )
    schema = "doc_id long, text_key binary, words binary, any boolean, bands array<long>"
    keyed = rows.withColumn("text_key", F.unhex(F.md5("text")))
    signed = scratch.stage(
        keyed.mapInArrow(lambda b: _sign(b, shingle_words), schema), "signatures"
    )
    first = F.min(
        F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key", "any", "bands")
    )
    texts = signed.groupBy("words").agg(first.alias("f")).select(
        F.monotonically_increasing_id().alias("node"), "words", F.col("f.doc_id").alias("rep"),
        F.col("f.text_key").alias("rep_key"), F.col("f.any").alias("any"),
        F.col("f.bands").alias("bands"),
    )
    texts = scratch.stage(texts, "texts")
    linked = _link(texts, keyed, similarity, shingle_words, scratch)
    placed = texts.select("node", "words", "rep").join(linked, "node", "left")
    placed = placed.withColumn("root", F.coalesce("component", "node"))
    classes = placed.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = placed.select("root", "words").join(classes, "root").select("words", "class_id")
    classes = scratch.stage(classes, "classes")
    return signed.select("doc_id", "text_key", "words").join(classes, "words").select(
        "doc_id", "text_key", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    )


def without_near_duplicates(docs: DataFrame, *, scratch: Scratch, **options) -> DataFrame:
    """The rows that ``near_duplicates`` keeps, one of each class, columns unchanged.

    Rows that share an id and a text stay or go together; so do rows of one id whose
    texts are of one class.
    """
    id_column, text_column = (
        options.get(f"{c}_column", d) for c, d in (("id", "doc_id"), ("text", "text"))
    )
    kept = near_duplicates(docs, scratch=scratch, **options).filter("kept")
    kept = scratch.stage(kept.select("doc_id", "text_key"), "kept")
    body = F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    rows = docs.select(
        body, named(id_column).cast("long").alias("id"),
        F.unhex(F.md5(text_of(text_column))).alias("key"),
    )
    same = F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("text_key"))
    rows = rows.join(kept, same, "left_semi")
    return rows.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
