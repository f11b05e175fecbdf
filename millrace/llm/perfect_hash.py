"""Minimal perfect hashes of sets of words, in shards of bounded size.

A shard is a row of bit levels. On each level every key left over hashes to a bit; bits
hit by one key alone are set and place that key, the others try the next level. The
number of set bits before a key's bit is its slot, found by a rank directory. Keys that
no level places stand in a list of their own. The keys themselves are stored in the
order of their slots, so a word that is no key is told from one by comparing it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Keys of a shard, on average.
SHARD_KEYS = 1 << 16

LEVELS = 24

# Bits of a level for each key that reaches it.
BITS_PER_KEY = 2

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def _mixed(values: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit number spread over all of it."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(32))


def flat_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of words in a row, and the end of each word."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[1:] - offsets[0]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of the words, a polynomial of their bytes that is then mixed."""
    if not len(words):
        return np.zeros(0, np.uint64)
    data, ends = flat_bytes(words)
    lengths = np.diff(ends, prepend=0)
    powers = np.ones(int(lengths.max(initial=1)) + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    at = np.arange(len(data)) - np.repeat(ends - lengths, lengths)
    terms = np.concatenate([(data.astype(np.uint64) + np.uint64(1)) * powers[at], np.zeros(1, np.uint64)])
    sums = np.add.reduceat(terms, ends - lengths)
    sums[lengths == 0] = 0
    return _mixed(sums + lengths.astype(np.uint64) * _STEP)


def shard_numbers(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each hash, from bits that the levels do not use alone."""
    return (_mixed(hashes ^ _STEP) % np.uint64(max(shards, 1))).astype(np.int64)


def _level_bits(hashes: np.ndarray, level: int, size: np.ndarray | int) -> np.ndarray:
    seed = np.uint64((level + 1) * int(_STEP) % (1 << 64))
    seeded = _mixed(hashes + seed)
    return (seeded % np.asarray(size, np.uint64)).astype(np.int64)


def build_shard(words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Bits by level, 64-bit words of all levels, and the distinct keys by slot.

    The levels of a shard start at whole words. Keys without a place come last.
    """
    hashes = word_hashes(words)
    left = np.arange(len(words))
    sizes, bits, placed = np.zeros(LEVELS, np.int64), [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = sizes[level] = -(-len(left) * BITS_PER_KEY // 64) * 64
        at = _level_bits(hashes[left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        bits.append(alone)
        own = alone[at]
        placed.append(left[own][np.argsort(at[own])])
        left = left[~own]
    flags = np.concatenate(bits) if bits else np.zeros(0, bool)
    order = np.concatenate([*placed, left]) if len(words) else left
    packed = np.packbits(flags, bitorder="little").view("<u8")
    return sizes, packed, words.take(pa.array(order, pa.int64()))


class PerfectHash:
    """Slots of words in several shards of one set; slots count on through the shards."""

    def __init__(self, shards: Sequence[tuple[np.ndarray, np.ndarray, pa.Array]], of: np.ndarray,
                 all_shards: int) -> None:
        """``of`` has the numbers of the shards at hand, among ``all_shards``."""
        self.all_shards = all_shards
        self.place = np.full(max(all_shards, 1), -1)
        self.place[of] = np.arange(len(of))
        self.sizes = np.stack([s[0] for s in shards])
        starts = np.concatenate([[0], np.cumsum(self.sizes.ravel())])[:-1]
        self.starts = starts.reshape(self.sizes.shape)
        self.words = np.concatenate([s[1] for s in shards])
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.ranks = np.cumsum(counts) - counts
        self.keys = pa.concat_arrays([s[2].cast(pa.large_string()) for s in shards])
        keys = np.array([len(s[2]) for s in shards])
        bits = np.array([int(np.bitwise_count(s[1]).sum()) for s in shards])
        # Slots before a shard less the bits before it.
        self.shift = (np.cumsum(keys) - keys) - (np.cumsum(bits) - bits)
        ends = np.cumsum(keys)
        spare = [np.arange(e - (k - b), e) for e, k, b in zip(ends, keys, bits)]
        self.spare = np.concatenate(spare)
        self.spare_keys = self.keys.take(pa.array(self.spare, pa.int64()))

    def __len__(self) -> int:
        return len(self.keys)

    def slots(self, words: pa.Array) -> np.ndarray:
        """The slot of each word; -1 for words that are no key."""
        words = words.cast(pa.large_string())
        hashes = word_hashes(words)
        shard = self.place[shard_numbers(hashes, self.all_shards)]
        found = np.full(len(words), -1)
        left = np.flatnonzero(shard >= 0)
        for level in range(LEVELS):
            left = left[self.sizes[shard[left], level] > 0]
            if not len(left):
                break
            own = shard[left]
            bit = self.starts[own, level] + _level_bits(hashes[left], level, self.sizes[own, level])
            word, inside = self.words[bit >> 6], (bit & 63).astype(np.uint64)
            is_set = (word >> inside) & np.uint64(1) == 1
            before = np.bitwise_count(word & ((np.uint64(1) << inside) - np.uint64(1)))
            rank = self.ranks[bit >> 6] + before + self.shift[own]
            found[left[is_set]] = rank[is_set]
            left = left[~is_set]
        if len(self.spare):
            at = pc.fill_null(pc.index_in(words, self.spare_keys), -1).to_numpy(False)
            found = np.where(at >= 0, self.spare[at], found)
        hit = np.flatnonzero(found >= 0)
        same = pc.equal(self.keys.take(pa.array(found[hit])), words.take(pa.array(hit)))
        found[hit[~same.to_numpy(False)]] = -1
        return found
