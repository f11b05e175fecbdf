"""Language-model scores by a weighted backoff automaton.

Tokens are lower-case words and an end mark. Every word that was learned is a state,
every pair of neighbours an arc, and every state has a failure arc to the root, which
holds all words. Pairs are smoothed towards the root by a Dirichlet prior of strength
K, so that an arc and the failure arc beside it weigh

    arc(v, w) = c(v, w) / (c(v) + K)        fail(v) = K / (c(v) + K)
    P(w | v)  = arc(v, w) + fail(v) P(w)
    P(w)      = (c(w) - D) / N for known words, D V / N for unknown ones

and the probabilities of a state sum to one. A text is read from left to right: the
state is the last word, or the root if that was never learned; the end mark is the
state a text starts in.

All words and pairs are learned, so the automaton grows with the text and no task
holds it. Texts come in slices; a slice asks for the counts of its own distinct words
and pairs, and adds its own: keys are sorted hashes, dealt by range into shards and
packed, one block per slice and shard. A shard sums the counts of all its blocks and
answers each block. With its answers a slice has the part of the automaton that its
texts can reach, and walks it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, named, text_of
from millrace.operators.lookups import planned_bytes
from millrace.scratch import Scratch
from millrace.sources.tables import UNMEASURED

END = 10
BLANK = 32

# Strength of the prior; on held-out texts of the test tables the best of 1 to 3,000.
STRENGTH = 200.0

# Bytes of text in a slice, and bytes of stored documents for each shard.
SLICE = 8 << 20
SHARD_BYTES = 8 << 20

END_KEY = np.int64(xxhash.xxh64_intdigest(b"\n") - (1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = BLANK


def plain_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts, lower case A-Z, with single blanks and an end mark each.

    Returns the bytes, where each text ends in them, and its number of words.
    """
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    data = _LOWER[raw]
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    keep = data != BLANK
    before = np.ones(len(data), bool)
    before[1:] = ~keep[:-1]
    starts = (offsets[:-1] - offsets[0])[sizes > 0]
    before[starts] = True
    word = keep & before
    words = np.bincount(owner[word], minlength=len(sizes))
    data, owner, word = data[keep], owner[keep], word[keep]
    gap = word.copy()
    first = np.searchsorted(owner, np.flatnonzero(words))
    gap[first] = False
    place = np.cumsum(1 + gap) - 1 + owner
    kept = np.bincount(owner, minlength=len(sizes)) + np.maximum(words - 1, 0)
    ends = np.cumsum(kept + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, BLANK, np.uint8)
    out[place] = data
    out[ends - 1] = END
    return out, ends, words


def word_codes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words, and for every word in turn which one it is."""
    starts = np.concatenate([[0], ends[:-1]])
    size = np.maximum(ends - starts - 1, 0)
    at = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    offsets = np.concatenate([[0], np.cumsum(size)])
    texts = pa.Array.from_buffers(
        pa.large_string(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])]
    )
    coded = pc.split_pattern(texts.filter(pa.array(size > 0)), " ").flatten().dictionary_encode()
    names = coded.dictionary.to_pylist()
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    return hashes.view(np.int64), coded.indices.to_numpy()


def with_end_marks(
    codes: np.ndarray, words: np.ndarray, mark: int
) -> tuple[np.ndarray, np.ndarray]:
    """Words of all texts with the end mark after each text, and where texts end."""
    ends = np.cumsum(words + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, mark, np.int64)
    kept = np.ones(len(out), bool)
    kept[ends - 1] = False
    out[kept] = codes
    return out, ends


@dataclass(frozen=True)
class Automaton:
    """Root weights of words, and the arcs of their states.

    Words have numbers, the end mark the last. The state of a word has its number plus
    one, 0 is the root. ``fail`` is the weight of each state's failure arc; ``arcs`` are
    sorted ``state * words + word``.
    """

    root: np.ndarray
    state: np.ndarray
    fail: np.ndarray
    arcs: np.ndarray
    weights: np.ndarray

    @classmethod
    def of_counts(
        cls, words: np.ndarray, arcs: np.ndarray, counts: np.ndarray, totals: Totals, strength: float
    ) -> Automaton:
        """The part of the automaton that has these words, and arcs ``first * words +
        second`` among them, sorted, with their counts."""
        n = len(words)
        known = words > 0
        state = np.where(known, np.arange(1, n + 1), 0)
        fail = np.concatenate([[1.0], strength / (words + strength)])
        first = arcs // max(n, 1)
        weights = counts / (words[first] + strength)
        return cls(totals.root(words), state, fail, arcs + n, weights)

    def weight(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Weight of the arc by each word, and of the failure arc and the root's arc."""
        wanted = state * len(self.root) + word
        found = np.zeros(len(word))
        if len(self.arcs):
            place = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            hit = (self.arcs[place] == wanted) & (state > 0)
            found[hit] = self.weights[place[hit]]
        return found + self.fail[state] * self.root[word]


def walk(automaton: Automaton, path: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log10 weights along the way of all texts, by token.

    ``path`` has the words of all texts, the end mark last in each. What a word leads
    to is its own state or the root, whatever came before it; so the states that a
    reader carries from token to token are those of the words one place earlier.
    """
    carried = np.empty(len(path), np.int64)
    carried[1:] = automaton.state[path[:-1]]
    carried[np.concatenate([[0], ends[:-1]])[: len(ends)]] = automaton.state[-1]
    return np.log10(automaton.weight(carried, path))


@dataclass(frozen=True)
class Totals:
    """Of the texts learned from: tokens, distinct tokens, and the words' discount."""

    tokens: int
    distinct: int
    discount: float

    def root(self, counts: np.ndarray) -> np.ndarray:
        """Probabilities of tokens; all are 1 if nothing was learned."""
        if not self.tokens:
            return np.ones(len(counts))
        unknown = self.discount * self.distinct / self.tokens
        return np.where(counts > 0, (counts - self.discount) / self.tokens, unknown)


def _joined(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the pairs of two words each."""
    x = before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + last.view(np.uint64)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as many bytes each as the largest needs."""
    numbers = np.ascontiguousarray(numbers, "<u8")
    width = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return bytes([width]) + numbers.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    width = data[0]
    found = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    out = np.zeros((len(found), 8), np.uint8)
    out[:, :width] = found
    return out.view("<u8").ravel()


@dataclass(frozen=True)
class Slice:
    """Distinct words and pairs of some texts, in the order of their hashes.

    ``path`` and ``pair`` have the number of each token's word and of the pair that
    ends there, ``ends`` the places after each text. The end mark is the last word:
    ``rank`` has each word's place by hash, ``pairs`` are ``first * words + second``.
    """

    path: np.ndarray
    pair: np.ndarray
    ends: np.ndarray
    rank: np.ndarray
    pairs: np.ndarray
    pair_rank: np.ndarray
    word_keys: np.ndarray
    pair_keys: np.ndarray

    @classmethod
    def of(cls, texts: pa.Array) -> Slice:
        data, text_ends, words = plain_bytes(texts)
        hashes, codes = word_codes(data, text_ends)
        path, ends = with_end_marks(codes, words, len(hashes))
        keys = np.append(hashes, END_KEY)
        before = np.empty(len(path), np.int64)
        before[1:] = path[:-1]
        before[np.concatenate([[0], ends[:-1]])[: len(ends)]] = len(hashes)
        pairs, pair = np.unique(before * len(keys) + path, return_inverse=True)
        pair_keys = _joined(keys[pairs // len(keys)], keys[pairs % len(keys)]).view(np.uint64)
        keys = keys.view(np.uint64)
        order, pair_order = np.argsort(keys), np.argsort(pair_keys)
        return cls(
            path, pair, ends, _inverse(order), pairs, _inverse(pair_order),
            keys[order], pair_keys[pair_order],
        )

    def counts(self, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words and pairs, by hash, in the texts that are learned from."""
        token = np.repeat(learned, np.diff(self.ends, prepend=0))
        words = np.bincount(self.rank[self.path[token]], minlength=len(self.word_keys))
        pairs = np.bincount(self.pair_rank[self.pair[token]], minlength=len(self.pair_keys))
        return words, pairs


def _inverse(order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank


def _bounds(keys: np.ndarray, shards: int) -> np.ndarray:
    """Where the keys of each shard begin among sorted keys, and where the last ends."""
    limits = np.array([(i << 64) // shards for i in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])


BLOCK = "slice long, level int, shard int, keys binary, counts binary"
ANSWER = (
    "slice long, level int, shard int, counts binary, tokens long, distinct long, once long, twice long"
)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of one task's texts with their numbers; the same whenever it runs."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for piece in byte_slices(batch, "text", SLICE):
            yield number, piece
            number += 1


def _ask(rows: DataFrame, shards: int) -> DataFrame:
    """Blocks of the distinct words and pairs of each slice, with the counts it adds."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, piece in _slices(batches):
            found = Slice.of(piece.column("text"))
            counts = found.counts(np.asarray(piece.column("learned")))
            blocks = []
            for level, (keys, n) in enumerate(zip((found.word_keys, found.pair_keys), counts)):
                bounds = _bounds(keys, shards).tolist()
                for shard, (a, b) in enumerate(zip(bounds, bounds[1:])):
                    if a < b:
                        gaps = np.diff(keys[a:b], prepend=np.uint64(0))
                        gaps[0] -= np.uint64((shard << 64) // shards)
                        blocks.append((number, level, shard, packed(gaps), packed(n[a:b])))
            yield _batch(blocks, BLOCK)

    return rows.mapInArrow(ask, BLOCK)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    arrays = [pa.array(column, kinds[kind]) for column, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _answered(blocks: pa.Table, shards: int) -> pa.Table:
    """What all blocks of a shard count together, for each block, and totals of words."""
    level, shard = blocks.column("level")[0].as_py(), blocks.column("shard")[0].as_py()
    start = np.uint64((shard << 64) // shards)
    keys = [np.cumsum(unpacked(k.as_py()), dtype=np.uint64) + start for k in blocks.column("keys")]
    ends = np.cumsum([len(k) for k in keys])
    counts = np.concatenate([unpacked(n.as_py()) for n in blocks.column("counts")]).astype(np.int64)
    distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
    order = np.argsort(place, kind="stable")
    first = np.searchsorted(place[order], np.arange(len(distinct)))
    totals = np.add.reduceat(counts[order], first)
    rows = [
        (number, level, shard, packed(totals[place[end - len(k) : end]]), 0, 0, 0, 0)
        for number, k, end in zip(blocks.column("slice").to_pylist(), keys, ends)
    ]
    if level == 0:
        words = totals[distinct != END_KEY.view(np.uint64)]
        numbers = (totals.sum(), (totals > 0).sum(), (words == 1).sum(), (words == 2).sum())
        rows.append((-1, level, shard, b"", *map(int, numbers)))
    return pa.Table.from_batches([_batch(rows, ANSWER)])


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _walked(table: pa.Table, totals: Totals, strength: float) -> pa.Table:
    """Scores of the texts of one slice, with the answers it got."""
    is_text = np.asarray(table.column("is_text"))
    texts = table.filter(pa.array(is_text)).sort_by("place")
    answers = table.filter(pa.array(~is_text)).sort_by([("level", "ascending"), ("shard", "ascending")])
    found = Slice.of(texts.column("text").combine_chunks())
    level = np.asarray(answers.column("level"))
    counts = []
    for number, keys in enumerate((found.word_keys, found.pair_keys)):
        parts = [unpacked(a.as_py()) for a in answers.column("counts").filter(pa.array(level == number))]
        counts.append(np.concatenate([np.zeros(0, np.uint64), *parts]).astype(np.int64))
        if len(counts[-1]) != len(keys):
            raise RuntimeError("A slice was read anew with other texts; write the documents out first.")
    words, pairs = counts[0][found.rank], counts[1][found.pair_rank]
    learned = pairs > 0
    automaton = Automaton.of_counts(words, found.pairs[learned], pairs[learned], totals, strength)
    weights = walk(automaton, found.path, found.ends)
    text = np.repeat(np.arange(len(texts)), np.diff(found.ends, prepend=0))
    base = np.log10((words + 1) / (totals.tokens + totals.distinct + 1))
    return pa.table(
        {
            "doc_id": texts.column("doc_id"),
            "n_tokens": np.diff(found.ends, prepend=0),
            "n_known": np.bincount(text, words[found.path] > 0, len(texts)).astype(np.int64),
            "base_score": np.bincount(text, base[found.path], len(texts)),
            "score": np.bincount(text, weights, len(texts)),
        }
    )


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether a row is kept from training; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def score_texts(
    docs: DataFrame,
    learn: Column,
    *,
    scratch: Scratch,
    strength: float = STRENGTH,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Scores of every row, whole texts, by the model of the rows where ``learn`` is true.

    ``doc_id``, ``n_tokens``, ``n_known`` (tokens learned), ``train_tokens``,
    ``base_score`` (words alone, add-one) and ``score`` (the automaton). Tokens are words
    and one end mark; a null text is an empty one. Words and pairs are counted by 64-bit
    hashes. Repeated rows are learned and scored each; an empty table gives an empty
    result, and a model of no texts scores of 0; other columns are ignored.

    Texts are read twice and must come in the same order both times, as from files;
    other frames are written out first.
    """
    rows = docs.select(
        named(id_column).cast("long").alias("doc_id"),
        text_of(text_column).alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learned"),
    )
    if UNMEASURED.search(rows._jdf.queryExecution().optimizedPlan().toString()):
        rows = scratch.stage(rows, "texts")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(tasks, planned_bytes(rows) // SHARD_BYTES)
    blocks = _ask(rows, shards).groupBy("level", "shard")
    answers = scratch.stage(blocks.applyInArrow(lambda t: _answered(t, shards), ANSWER), "answers")
    tokens, distinct, once, twice = answers.agg(
        *[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "distinct", "once", "twice")]
    ).first()
    totals = Totals(tokens, distinct, min(max(once / max(once + 2 * twice, 1), 0.1), 0.9))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slice_, piece in _slices(batches):
            n = len(piece)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, slice_)), pa.array(np.arange(n)), *piece.columns],
                names=["slice", "place", *piece.schema.names],
            )

    texts = rows.mapInArrow(number, "slice long, place long, doc_id long, text string, learned boolean")
    texts = texts.select("slice", "place", "doc_id", "text", F.lit(True).alias("is_text"))
    replies = answers.filter("slice >= 0").select(
        "slice", "level", "shard", "counts", F.lit(False).alias("is_text")
    )
    meeting = texts.unionByName(replies, allowMissingColumns=True)
    scored = meeting.groupBy("slice").applyInArrow(lambda t: _walked(t, totals, strength), SCORED)
    return scored.select(
        "doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
