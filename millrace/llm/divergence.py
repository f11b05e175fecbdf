"""How the words of a source differ from those of its language and its other sources.

Words that stand in enough documents of a language are found by an exact count of
documents. Their minimal perfect hash, in shards of bounded size, is broadcast, and a
second pass over all texts looks every word up and counts it in the slot of its group:
densely for groups with much text, sorted for others. Shards that are too large to be
broadcast together take several passes. The rest are counts by group and slot: shares,
divergences of pairs of groups in blocks of slots, and the leading words of each group.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, text_of
from millrace.llm.perfect_hash import (
    SHARD_KEYS,
    PerfectHash,
    build_shard,
    flat_bytes,
    shard_numbers,
    word_hashes,
)
from millrace.scratch import Scratch

# Shares are whole numbers of this scale.
SCALE = 1_000_000_000

# Bytes of the shards that are broadcast for one pass.
BROADCAST_BYTES = 48 << 20

# Counters a task holds for its groups at a time.
DENSE_CELLS = 1 << 23

# A group with at least one word in a slice for so many slots is counted densely.
SLOTS_PER_WORD = 32

# Bytes of text turned into words at a time: the arrays of a slice take many times its size.
SLICE = 2 << 20

# Cells of groups by slots in a block of the pairwise sums.
BLOCK_CELLS = 1 << 21

# Bytes that are part of a word: ASCII letters and all bytes of other characters.
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and the text each belongs to.

    A word is a run of ASCII letters and of characters beyond ASCII; A to Z are
    lowered. Texts have no nulls.
    """
    data, ends = flat_bytes(texts)
    inside = _LETTER[data]
    starts_at = inside.copy()
    starts_at[1:] &= ~inside[:-1]
    firsts = (ends - np.diff(ends, prepend=0))[np.diff(ends, prepend=0) > 0]
    starts_at[firsts] = inside[firsts]
    starts = np.flatnonzero(starts_at)
    letters = _LOWER[data[inside]]
    before = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)
    offsets = np.append(before[starts] - 1, len(letters)).astype(np.int64)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(letters)]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), buffers)
    return words, np.searchsorted(ends, starts, "right")


def _codes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def count_documents(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Documents by language and word of each slice of ``size`` bytes of text."""
    for batch in batches:
        for part in byte_slices(batch, "text", size):
            words, owner = words_of(part.column("text"))
            if not len(words):
                continue
            code, terms = _codes(words)
            lang, langs = _codes(part.column("lang"))
            n = len(terms)
            once = np.unique(owner * n + code)
            pair, counts = np.unique(lang[once // n] * n + once % n, return_counts=True)
            columns = [langs.take(pa.array(pair // n)), terms.take(pa.array(pair % n))]
            columns = [c.cast(pa.string()) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts)], names=["lang", "term", "n"]
            )


def document_counts(rows: DataFrame) -> DataFrame:
    """Documents of each language by word: ``lang``, ``term``, ``n``."""
    size = SLICE

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return count_documents(batches, size)

    found = rows.select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    return found.groupBy("lang", "term").agg(F.sum("n").alias("n"))


def hash_shards(terms: DataFrame, scratch: Scratch) -> DataFrame:
    """Perfect hashes of each language's terms, one row per shard.

    ``lang``, ``shard``, ``shards`` of the language, ``sizes`` of the levels, ``bits``,
    ``keys`` by slot, ``base`` (slots of the language before the shard) and ``pass``,
    the number of the broadcast it goes with.
    """
    totals = terms.groupBy("lang").agg(
        F.ceil(F.count("*") / SHARD_KEYS).cast("long").alias("shards")
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, shards = word_hashes(batch.column("term")), batch.column("shards").to_numpy()
            found = np.zeros(len(hashes), np.int64)
            for count in np.unique(shards):
                own = shards == count
                found[own] = shard_numbers(hashes[own], int(count))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found)], names=[*batch.schema.names, "shard"]
            )

    def build(table: pa.Table) -> pa.Table:
        words = table.column("term").combine_chunks()
        sizes, bits, keys = build_shard(words)
        return pa.table(
            {
                "lang": [table.column("lang")[0].as_py()],
                "shard": [table.column("shard")[0].as_py()],
                "shards": [table.column("shards")[0].as_py()],
                "sizes": [sizes.tolist()],
                "bits": [bits.tobytes()],
                "keys": [keys],
                "bytes": [8 * len(keys) + len(flat_bytes(keys)[0]) + 2 * bits.nbytes],
            },
            pa.schema(
                [
                    ("lang", pa.string()), ("shard", pa.int64()), ("shards", pa.int64()),
                    ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()),
                    ("keys", pa.list_(pa.string())), ("bytes", pa.int64()),
                ]
            ),
        )

    numbered = terms.select("lang", "term").join(totals, "lang").mapInArrow(
        number, "lang string, term string, shards long, shard long"
    )
    built = numbered.groupBy("lang", "shard").applyInArrow(
        build,
        "lang string, shard long, shards long, sizes array<long>, bits binary, "
        "keys array<string>, bytes long",
    )
    built = scratch.stage(built, "hash-shards")
    # One narrow row per 65,536 terms is put in order.
    narrow = built.select("lang", "shard", F.size("keys").alias("n"), "bytes")
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    own, all_ = before.partitionBy("lang").orderBy("shard"), before.orderBy("lang", "shard")
    shipped = F.coalesce(F.sum("bytes").over(all_), F.lit(0))
    places = narrow.select(
        "lang",
        "shard",
        F.coalesce(F.sum("n").over(own), F.lit(0)).alias("base"),
        F.floor(shipped / BROADCAST_BYTES).alias("pass"),
    )
    return scratch.stage(built.join(places, ["lang", "shard"]), "placed-shards")


def _shipped(shards: DataFrame) -> bytes:
    """The perfect hashes of one pass, by language, with their first slot."""
    by_lang: dict[str, list] = {}
    for row in shards.orderBy("lang", "shard").toArrow().to_batches():
        for i in range(row.num_rows):
            one = {name: row.column(name)[i] for name in row.schema.names}
            by_lang.setdefault(one["lang"].as_py(), []).append(one)
    shipped = {}
    for lang, rows in by_lang.items():
        parts = [
            (
                np.array(r["sizes"].as_py(), np.int64),
                np.frombuffer(r["bits"].as_py(), "<u8"),
                r["keys"].values,
            )
            for r in rows
        ]
        of = np.array([r["shard"].as_py() for r in rows])
        shipped[lang] = (PerfectHash(parts, of, rows[0]["shards"].as_py()), rows[0]["base"].as_py())
    return pickle.dumps(shipped, protocol=5)


class _Slots:
    """Counts of one task by group, in dense arrays while these fit."""

    def __init__(self) -> None:
        self.dense: dict[tuple[str, str], np.ndarray] = {}
        self.cells = 0

    def add(
        self, group: tuple[str, str], slots: np.ndarray, size: int
    ) -> Iterator[tuple[tuple[str, str], np.ndarray, np.ndarray]]:
        """Count slots of a group; yields counts that are not kept."""
        if group not in self.dense and len(slots) * SLOTS_PER_WORD < size:
            yield (group, *np.unique(slots, return_counts=True))
            return
        if group not in self.dense:
            if self.cells + size > DENSE_CELLS:
                yield from self.emptied()
            self.dense[group] = np.zeros(size, np.int64)
            self.cells += size
        self.dense[group] += np.bincount(slots, minlength=size)

    def emptied(self) -> Iterator[tuple[tuple[str, str], np.ndarray, np.ndarray]]:
        for group, counts in self.dense.items():
            used = np.flatnonzero(counts)
            yield group, used, counts[used]
        self.dense, self.cells = {}, 0


COUNTED = "lang string, source string, slots array<long>, counts array<long>"


def _counted(found: Iterator[tuple[tuple[str, str], np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for (lang, source), slots, counts in found:
        for start in range(0, len(slots), 1 << 16):
            end = min(start + (1 << 16), len(slots))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang]),
                    pa.array([source]),
                    pa.ListArray.from_arrays([0, end - start], pa.array(slots[start:end])),
                    pa.ListArray.from_arrays([0, end - start], pa.array(counts[start:end])),
                ],
                names=["lang", "source", "slots", "counts"],
            )


def _recount(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """One pass: occurrences of the terms of these shards by group and slot."""
    broadcast = rows.sparkSession.sparkContext.broadcast(_shipped(shards))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = pickle.loads(broadcast.value)
        kept = _Slots()
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE):
                words, owner = words_of(part.column("text"))
                if not len(words):
                    continue
                code, terms = _codes(words)
                lang, langs = _codes(part.column("lang"))
                source, sources = _codes(part.column("source"))
                group = lang * len(sources) + source
                for number, name in enumerate(langs.to_pylist()):
                    if name not in hashes:
                        continue
                    hash_, base = hashes[name]
                    own = np.flatnonzero(lang[owner] == number)
                    present = np.zeros(len(terms), bool)
                    present[code[own]] = True
                    present = np.flatnonzero(present)
                    slot_of = np.full(len(terms), -1)
                    slot_of[present] = hash_.slots(terms.take(pa.array(present)))
                    slots = slot_of[code[own]]
                    own, slots = own[slots >= 0], slots[slots >= 0]
                    groups = group[owner[own]]
                    order = np.argsort(groups, kind="stable")
                    found, first = np.unique(groups[order], return_index=True)
                    for g, mine in zip(found.tolist(), np.split(slots[order], first[1:])):
                        key = (name, sources[g % len(sources)].as_py())
                        for item in kept.add(key, mine, len(hash_)):
                            yield from _counted([(item[0], item[1] + base, item[2])])
        for item in kept.emptied():
            yield from _counted([(item[0], item[1] + hashes[item[0][0]][1], item[2])])

    return rows.mapInArrow(count, COUNTED)


def term_counts(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``slot``, ``n`` of all kept terms that occur in a group."""
    passes = sorted(r[0] for r in shards.select("pass").distinct().collect())
    found = None
    for number in passes:
        one = _recount(rows, shards.filter(F.col("pass") == number))
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = rows.sparkSession.createDataFrame([], COUNTED)
    pairs = found.select("lang", "source", F.explode(F.arrays_zip("slots", "counts")).alias("one"))
    return pairs.groupBy("lang", "source", F.col("one.slots").alias("slot")).agg(
        F.sum("one.counts").alias("n")
    )


def _share(n: str, total: str, terms: str) -> Column:
    """The smoothed share of a count, a whole number; decimals keep it exact."""
    return F.expr(
        f"1 + ({SCALE} * cast({n} + 2 AS decimal(20, 0))) "
        f"div cast({total} + 2 * {terms} AS decimal(20, 0))"
    )


def _divergence(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _pair_sums(table: pa.Table) -> pa.Table:
    """Divergences of all pairs of groups over one block of slots.

    Rows without a slot name the groups, with the share of a term that a group lacks.
    """
    slot = table.column("slot")
    heads = slot.is_null().to_numpy()
    names = table.column("source").combine_chunks().filter(pa.array(heads))
    order = np.argsort(np.array(names.to_pylist(), object))
    names = names.take(pa.array(order))
    number = {name: i for i, name in enumerate(names.to_pylist())}
    p = table.column("p").to_numpy()
    width = int(table.column("width").to_numpy().max())
    shares = np.repeat(p[heads][order][:, None], width, axis=1)
    of = np.array([number[s] for s in table.column("source").filter(pa.array(~heads)).to_pylist()], np.int64)
    shares[of, slot.drop_null().to_numpy() - int(table.column("start")[0].as_py())] = p[~heads]
    a, b, values = [], [], []
    for i in range(len(names) - 1):
        gap = shares[i + 1 :] - shares[i]
        sums = (gap * gap // (shares[i + 1 :] + shares[i])).sum(1)
        a.append(np.full(len(sums), i))
        b.append(np.arange(i + 1, len(names)))
        values.append(sums)
    none = [np.zeros(0, np.int64)]
    return pa.table(
        {
            "lang": pa.repeat(table.column("lang")[0], sum(map(len, a))),
            "a": names.take(pa.array(np.concatenate(none + a))),
            "b": names.take(pa.array(np.concatenate(none + b))),
            "value": pa.array(np.concatenate(none + values)),
        }
    )


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """Divergence of each group from each other one of its language."""
    most = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    size = max(1, BLOCK_CELLS // most)
    last = F.greatest(F.expr(f"(terms - 1) div {size}"), F.lit(0).cast("long"))
    heads = groups.select(
        "lang",
        "source",
        F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"),
        F.lit(None).cast("long").alias("slot"),
        F.col("p_none").alias("p"),
        "terms",
    )
    cells = shares.select(
        "lang", "source", F.expr(f"slot div {size}").alias("block"), "slot", "p", "terms"
    )
    start = F.col("block") * size
    blocks = heads.unionByName(cells).select(
        "lang", "source", "block", "slot", "p", start.alias("start"),
        F.least(F.lit(size).cast("long"), F.col("terms") - start).alias("width"),
    )
    sums = blocks.groupBy("lang", "block").applyInArrow(
        _pair_sums, "lang string, a string, b string, value long"
    )
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    return sums.select("lang", F.explode(both).alias("one"), "value").select(
        "lang", "one.source", "one.item", "value"
    )


def source_divergence(
    docs: DataFrame,
    *,
    scratch: Scratch,
    least_documents: int = 10,
    leading: int = 10,
    text_column: str = "text",
    lang_column: str = "lang",
    source_column: str = "source",
) -> DataFrame:
    """How each (language, source) group diverges: ``lang``, ``source``, ``part``,
    ``item``, ``value``, ``rank``.

    Terms are runs of ASCII letters and characters beyond ASCII, with A to Z lowered;
    a language keeps those in ``least_documents`` of its documents or more. With a
    group's count of a kept term, its sum N over the V kept terms and
    ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``, two shares diverge by
    ``floor((p - q)^2 / (p + q))``. Part ``pair`` has every other source of the
    language with the sum over all kept terms, part ``term`` the ``leading`` terms
    that stand in the group with a larger share than in its language. Ranks go by
    falling value, then by rising item.

    Null texts, languages and sources are empty strings. Rows count each for itself,
    repeated ones too. A language without kept terms has pairs of value 0; a group
    alone in its language has no pairs; an empty table gives an empty result. Other
    columns are ignored.
    """
    rows = docs.select(
        text_of(lang_column).alias("lang"),
        text_of(source_column).alias("source"),
        text_of(text_column).alias("text"),
    )
    terms = document_counts(rows).filter(F.col("n") >= least_documents)
    shards = hash_shards(scratch.stage(terms.select("lang", "term"), "terms"), scratch)
    counts = scratch.stage(term_counts(rows, shards), "term-counts")

    words = shards.select("lang", "base", F.posexplode("keys").alias("at", "term"))
    words = words.select("lang", (F.col("base") + F.col("at")).alias("slot"), "term")
    kept = shards.groupBy("lang").agg(F.sum(F.size("keys")).alias("terms"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left")
    groups = groups.join(kept, "lang", "left").select(
        "lang", "source",
        F.coalesce("total", F.lit(0).cast("long")).alias("total"),
        F.coalesce("terms", F.lit(0).cast("long")).alias("terms"),
    )
    groups = scratch.stage(groups.withColumn("p_none", F.when(
        F.col("terms") > 0, _share("0", "total", "terms")).otherwise(0)), "groups")
    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "slot", "n", "terms", _share("n", "total", "terms").alias("p")
    )

    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    in_lang = counts.groupBy("lang", "slot").agg(F.sum("n").alias("n")).join(whole, "lang")
    in_lang = in_lang.select("lang", "slot", _share("n", "total", "terms").alias("q"))
    in_lang = in_lang.join(words, ["lang", "slot"])
    over = shares.join(in_lang, ["lang", "slot"]).filter("p > q")
    over = over.select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
        _divergence("p", "q").alias("value"),
    )
    pairs = _pairs(shares, groups).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value"
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    first = over.withColumn("rank", rank).filter(F.col("rank") <= leading)
    return pairs.withColumn("rank", rank).unionByName(first)
