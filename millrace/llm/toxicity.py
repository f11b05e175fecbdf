"""Toxicity by a factorization machine over hashed terms.

A text is the set of its terms, hashed into a fixed number of slots. The machine adds
a weight for each term and, for each pair of terms, the product of their factors, so a
pair such as an insult with the name of a group can weigh more than its parts do:

    logit = b + sum_i w_i + 1/2 sum_f ((sum_i v_if)^2 - sum_i v_if^2)

It is fitted on a bounded sample of labelled rows; every text is scored in tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, named, text_of
from millrace.scratch import Scratch

SLOTS = 1 << 18
FACTORS = 8

# Bytes of text turned into terms at a time: that takes ten times as much memory or more.
SLICE = 1 << 20

# Bound of the labelled rows the machine is fitted on, those with the smallest hashes.
SAMPLE_ROWS = 20_000

# Evidence a term must give on the labels to get weights, as the likelihood ratio
# statistic 2 ln L: by chance about one term in 100,000 reaches it.
LEAST_EVIDENCE = 20.0

# Two terms that tell nothing alone can tell together. Pairs are looked at among the terms
# in at least this share of the labelled texts, and give weights to both terms if they tell
# so much more than their terms do; by chance one pair in 4 billion reaches it.
PAIR_SUPPORT = 0.02
LEAST_PAIR_EVIDENCE = 40.0

# Terms whose pairs are counted at a time, as columns of a matrix of all labelled texts.
PAIR_BLOCK = 256

_WORD = re.compile(r"[^\W_]+")


def slot_pairs(texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and slot of every distinct term of every text, by row and slot.

    With ``wanted``, a mask of slots, others are left out.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    bounds = lists.offsets.to_numpy()
    coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(bounds))
    slots, sizes = [], []
    for unit in coded.dictionary.to_pylist():
        found = [xxhash.xxh64_intdigest(w) % SLOTS for w in _WORD.findall(unit.lower())]
        if wanted is not None:
            found = [slot for slot in found if wanted[slot]]
        slots += found
        sizes.append(len(found))
    sizes = np.array(sizes, np.int64)
    codes = coded.indices.to_numpy()
    per_unit = sizes[codes]
    ends = np.cumsum(per_unit)
    starts = (np.cumsum(sizes) - sizes)[codes]
    at = np.repeat(starts - (ends - per_unit), per_unit) + np.arange(ends[-1] if len(ends) else 0)
    keys = np.repeat(row, per_unit) * SLOTS + np.array(slots, np.int64)[at]
    keys = np.unique(keys)
    return keys // SLOTS, keys % SLOTS


def text_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task in pieces of ``SLICE`` bytes of text.

    The task's Python worker may come from another stage: what that one freed but
    kept is given back first.
    """
    pa.default_memory_pool().release_unused()
    for batch in batches:
        yield from byte_slices(batch, "text", SLICE)


def text_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and labels of all texts of one task, with their slots as 32-bit integers."""
    for piece in text_slices(batches):
        row, slot = slot_pairs(piece.column("text"))
        cells = np.split(slot.astype("<i4"), np.searchsorted(row, np.arange(1, len(piece))))
        yield pa.RecordBatch.from_arrays(
            [
                piece.column("doc_id"),
                piece.column("toxic"),
                pa.array([c.tobytes() for c in cells[: len(piece)]], pa.binary()),
            ],
            names=["doc_id", "toxic", "terms"],
        )


@dataclass(frozen=True)
class Machine:
    """Weights by slot; slots that tell nothing, alone or in a pair, have none."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def logits(self, rows: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
        total = self.bias + np.bincount(rows, self.weights[slots], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[slots, f]
            s = np.bincount(rows, v, n)
            total += 0.5 * (s * s - np.bincount(rows, v * v, n))
        return total

    def scores(self, texts: pa.Array) -> np.ndarray:
        rows, slots = slot_pairs(texts, (self.weights != 0) | self.factors.any(1))
        return 1 / (1 + np.exp(-np.clip(self.logits(rows, slots, len(texts)), -40, 40)))


def evidence(terms: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Likelihood ratio statistic of each slot: labels of texts with it and without."""
    slots = np.concatenate(terms)
    kinds = np.repeat(labels, [len(t) for t in terms])
    with_term = np.stack([np.bincount(slots[kinds == k], minlength=SLOTS) for k in (0, 1)])
    all_ = np.array([[np.sum(labels == k)] for k in (0, 1)], float)
    total = np.zeros(SLOTS)
    for counts in (with_term, all_ - with_term):
        expected = counts.sum(0) * all_ / all_.sum()
        ratio = np.where(counts > 0, counts / np.maximum(expected, 1e-12), 1.0)
        total += 2 * (counts * np.log(ratio)).sum(0)
    return total


def _self_log(counts: np.ndarray) -> np.ndarray:
    """``n ln n`` of whole numbers."""
    return counts * np.log(np.maximum(counts, 1.0))


def _label_evidence(cells: list[tuple[np.ndarray, np.ndarray]], whole: float) -> np.ndarray:
    """Likelihood ratio statistic of texts parted into cells, given as (all, label 1)."""
    total = whole
    for all_, ones in cells:
        total = total + _self_log(ones) + _self_log(all_ - ones) - _self_log(all_)
    return 2 * total


def paired_terms(terms: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Slots of pairs that tell more about the labels than their two terms do.

    All pairs of terms with ``PAIR_SUPPORT`` are counted, block by block, so that memory
    is that of two blocks whatever the number of terms.
    """
    sizes = [len(t) for t in terms]
    slots = np.concatenate(terms)
    row = np.repeat(np.arange(len(terms)), sizes)
    seen = np.bincount(slots, minlength=SLOTS)
    common = np.flatnonzero(seen >= max(2, PAIR_SUPPORT * len(terms)))
    place = np.full(SLOTS, -1)
    place[common] = np.arange(len(common))
    at = place[slots]
    row, at = row[at >= 0], at[at >= 0]
    n, n1 = float(len(terms)), float(labels.sum())
    whole = float(_self_log(np.array(n)) - _self_log(np.array([n1, n - n1])).sum())
    # Counts below 2^24 are exact in single precision.
    y = labels.astype(np.float32)[:, None]

    def block(first: int) -> np.ndarray:
        inside = (at >= first) & (at < first + PAIR_BLOCK)
        cells = np.zeros((len(terms), min(PAIR_BLOCK, len(common) - first)), np.float32)
        cells[row[inside], at[inside] - first] = 1
        return cells

    all_ = seen[common].astype(float)
    ones = np.bincount(at, labels[row], len(common))
    alone = _label_evidence([(all_, ones), (n - all_, n1 - ones)], whole)
    told = np.zeros(len(common), bool)
    for a in range(0, len(common), PAIR_BLOCK):
        left = block(a)
        i = slice(a, a + left.shape[1])
        for b in range(a, len(common), PAIR_BLOCK):
            right = left if b == a else block(b)
            j = slice(b, b + right.shape[1])
            both, both1 = (left.T @ right).astype(float), ((left * y).T @ right).astype(float)
            ai, aj, oi, oj = all_[i, None], all_[None, j], ones[i, None], ones[None, j]
            cells = [
                (both, both1), (ai - both, oi - both1), (aj - both, oj - both1),
                (n - ai - aj + both, n1 - oi - oj + both1),
            ]
            more = _label_evidence(cells, whole) - alone[i, None] - alone[None, j]
            hit = more >= LEAST_PAIR_EVIDENCE
            if b == a:
                np.fill_diagonal(hit, False)
            told[i] |= hit.any(1)
            told[j] |= hit.any(0)
    return common[told]


def fit(
    terms: list[np.ndarray],
    labels: np.ndarray,
    *,
    epochs: int = 40,
    batch: int = 256,
    rate: float = 0.2,
    decay: float = 1e-4,
    seed: int = 17,
) -> Machine:
    """Logistic loss by AdaGrad over the distinct slots of each labelled text.

    With labels of one kind only there is nothing to separate: the score of every text
    is then that label, and 0 without labels.
    """
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        bias = 40.0 if share else -40.0
        return Machine(bias, np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32))
    used = np.flatnonzero(evidence(terms, labels) >= LEAST_EVIDENCE)
    used = np.union1d(used, paired_terms(terms, labels))
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    terms = [p[p >= 0] for p in (place[t] for t in terms)]
    random = np.random.default_rng(seed)
    w = np.zeros(len(used))
    v = random.normal(0, 0.01, (len(used), FACTORS))
    gw, gv = np.full(len(used), 1e-2), np.full((len(used), FACTORS), 1e-2)
    bias, gb = float(np.log(share / (1 - share))), 1e-2
    for _ in range(epochs):
        order = random.permutation(len(terms))
        for start in range(0, len(order), batch):
            some = order[start : start + batch]
            sizes = np.array([len(terms[i]) for i in some])
            slot = np.concatenate([terms[i] for i in some])
            row = np.repeat(np.arange(len(some)), sizes)
            vs = v[slot]
            sums = np.stack([np.bincount(row, vs[:, f], len(some)) for f in range(FACTORS)], 1)
            squares = np.bincount(row, (vs * vs).sum(1), len(some))
            logit = bias + np.bincount(row, w[slot], len(some)) + 0.5 * ((sums**2).sum(1) - squares)
            error = 1 / (1 + np.exp(-np.clip(logit, -40, 40))) - labels[some]
            g = error.sum()
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if not len(slot):
                continue
            hit, inverse = np.unique(slot, return_inverse=True)
            e = error[row]
            g = np.bincount(inverse, e, len(hit)) + decay * w[hit]
            gw[hit] += g * g
            w[hit] -= rate * g / np.sqrt(gw[hit])
            pull = e[:, None] * (sums[row] - vs)
            g = np.stack([np.bincount(inverse, pull[:, f], len(hit)) for f in range(FACTORS)], 1)
            g += decay * v[hit]
            gv[hit] += g * g
            v[hit] -= 0.3 * rate * g / np.sqrt(gv[hit])
    weights, factors = np.zeros(SLOTS, np.float32), np.zeros((SLOTS, FACTORS), np.float32)
    weights[used], factors[used] = w, v
    return Machine(bias, weights, factors)


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """Whether a row is kept from training; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    scratch: Scratch,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    sample_rows: int = SAMPLE_ROWS,
) -> Machine:
    """Fit on the labelled rows that are not held out, ``sample_rows`` of them at most.

    An id with several labels counts as toxic if one of them says so; null labels and
    null ids are ignored.
    """
    known = labels.select(
        named(id_column).alias("doc_id"), named(label_column).cast("int").alias("toxic")
    ).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    known = scratch.stage(known, "labels")
    texts = docs.select(named(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    rows = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")

    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(text_terms, f"doc_id {id_type}, toxic int, terms binary")
    found = scratch.stage(found, "sample").orderBy(F.xxhash64("doc_id"), "doc_id", "terms")
    sample = found.limit(sample_rows).select("toxic", "terms").toArrow()
    terms = [np.frombuffer(t, "<i4") for t in sample.column("terms").to_pylist()]
    return fit(terms, (np.asarray(sample.column("toxic")) > 0).astype(float))


def score_texts(
    docs: DataFrame, machine: Machine, *, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id`` and ``score``, 0 to 1, of every row, whole texts.

    A null text is an empty one; texts without known terms get the share of label 1.
    Repeated rows are scored each; an empty table gives an empty result; other columns
    are ignored.
    """
    rows = docs.select(named(id_column).alias("doc_id"), text_of(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in text_slices(batches):
            scores = pa.array(shared.value.scores(piece.column("text")))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), scores], names=["doc_id", "score"]
            )

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"doc_id {id_type}, score double")


def without_toxic(
    docs: DataFrame, machine: Machine, *, text_column: str = "text", limit: float = 0.5
) -> DataFrame:
    """The rows whose texts score below ``limit``, all their columns unchanged.

    A null text scores as an empty one and stays null; ids are not looked at; repeated
    rows go or stay alike; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    at = docs.columns.index(text_column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], names=["text"])
            scores = [shared.value.scores(p.column("text")) for p in text_slices([texts])]
            if scores:
                yield batch.filter(pa.array(np.concatenate(scores) < limit))

    # Names with dots would be taken for fields on the way.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(keep, plain.schema).toDF(*docs.columns)
