"""Token ids of whole texts, made in Spark tasks with the tokenizers library.

A tokenizer cuts a text into words before it merges anything, so a text that is cut
at such a boundary first has the same ids. ``TextTokenizer`` cuts texts into units
at blanks, hands each distinct unit to the tokenizer once, and gathers the ids.
Which boundaries are safe follows from the tokenizer's own description; where none
is known to be, units are whole texts.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Units remembered by one Python worker; beyond it the memory starts afresh.
REMEMBERED_UNITS = 1_000_000

_CUT = "\x1f"
# Marks that follow a word's last letter never share a token with it.
_TAIL = ".,!?;:*%$&#|"
_BEFORE_WORD = re.compile(r" (?=\S)")
# Where a blank or line end stands beside another blank, cuts need a closer look.
_BLANK_RUN = r"[ \n][\s\v\p{Z}\x{85}\x1c-\x1f]|[\s\v\p{Z}\x{85}\x1c-\x1f]\n|\x1f"


def cutting_rule(description: dict) -> str:
    """``drop``: blanks are no part of any token; ``lead``: one blank belongs to the
    word after it; ``none``: nothing is known."""
    normalizer = description.get("normalizer")
    splitter = description.get("pre_tokenizer") or {}
    if (
        normalizer is None
        and splitter.get("type") == "ByteLevel"
        and splitter.get("use_regex", True)
        and not splitter.get("add_prefix_space", True)
    ):
        return "lead"
    steps = splitter.get("pretokenizers") or [splitter]
    if (
        steps[0].get("type") == "Split"
        and steps[0].get("invert")
        and steps[0].get("behavior") == "Removed"
        and r"[^\s" in (steps[0].get("pattern") or {}).get("Regex", "")
        and not any(s.get("add_prefix_space") for s in steps)
    ):
        return "drop"
    return "none"


def ragged_take(
    values: np.ndarray, starts: np.ndarray, lengths: np.ndarray
) -> np.ndarray:
    """The pieces ``values[start : start + length]`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(starts - (ends - lengths), lengths)
    at += np.arange(total, dtype=at.dtype)
    return values[at]


def split_tails(units: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Units without the marks after their last letter, and these marks."""
    words = pc.utf8_rtrim(units, characters=_TAIL)
    lettered = pc.utf8_is_alpha(pc.utf8_slice_codeunits(words, -1))
    words = pc.if_else(lettered, words, units)
    ends = np.frombuffer(units.buffers()[1], np.int64)[units.offset :][1 : len(units) + 1]
    sizes = pc.subtract(pc.binary_length(units), pc.binary_length(words)).to_numpy(False)
    sizes = sizes.astype(np.int64)
    data = np.frombuffer(units.buffers()[2] or b"", np.uint8)
    tails = ragged_take(data, ends - sizes, sizes)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(tails)]
    return words, pa.Array.from_buffers(pa.large_string(), len(units), buffers)


class TextTokenizer:
    """Ids of texts as little-endian unsigned integers of ``dtype``."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.rule = cutting_rule(json.load(file))
        self._tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._values = np.zeros(0, self.dtype)
        self._ends = np.zeros(1, np.int64)

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [np.zeros(0, self.dtype)], []
        for at in range(0, len(texts), 10_000):
            some = self._tokenizer.encode_batch_fast(
                texts[at : at + 10_000], add_special_tokens=False
            )
            found = [encoded.ids for encoded in some]
            sizes += map(len, found)
            parts.append(np.fromiter(chain.from_iterable(found), self.dtype))
        return np.concatenate(parts), np.array(sizes, np.int64)

    def _numbers(self, units: list[str]) -> np.ndarray:
        """Places of the units in the memory, which learns the new ones."""
        known = self._known
        if len(known) > REMEMBERED_UNITS:
            self._forget()
            known = self._known
        new = list(dict.fromkeys(unit for unit in units if unit not in known))
        ids, sizes = self._ids(new)
        known.update(zip(new, range(len(known), len(known) + len(new))))
        self._values = np.concatenate([self._values, ids])
        self._ends = np.concatenate([self._ends, self._ends[-1] + np.cumsum(sizes)])
        return np.fromiter(map(known.__getitem__, units), np.int64, len(units))

    def _unit_ids(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units in a row, and each one's number of ids."""
        parts = [part.dictionary_encode() for part in split_tails(units)]
        names = [part.dictionary.to_pylist() for part in parts]
        numbers = self._numbers([*names[0], *names[1]])
        places = (numbers[: len(names[0])], numbers[len(names[0]) :])
        both = np.stack([n[p.indices.to_numpy()] for n, p in zip(places, parts)], 1).ravel()
        lengths = self._ends[both + 1] - self._ends[both]
        values = ragged_take(self._values, self._ends[both], lengths)
        return values, lengths.reshape(-1, 2).sum(1)

    def _cut_text(self, text: str) -> str:
        """A text with runs of blanks, cut before each blank that leads a word."""
        first, *rest = _BEFORE_WORD.split(text)
        return _CUT.join([first, *[f" {unit}" for unit in rest]])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row without special tokens, and each text's number
        of ids. A null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole: dict[int, np.ndarray] = {}
        if self.rule == "none":
            return self._ids(texts.to_pylist())
        elif self.rule == "lead":
            odd = np.flatnonzero(pc.match_substring_regex(texts, _BLANK_RUN).to_numpy(False))
            cut = pc.replace_substring(texts, " ", f"{_CUT} ")
            cut = pc.replace_substring(cut, "\n", f"{_CUT}\n{_CUT}")
            if len(odd):
                fixed = cut.to_pylist()
                for i in odd.tolist():
                    text = texts[i].as_py()
                    if _CUT in text:
                        fixed[i], whole[i] = "", self._ids([text])[0]
                    else:
                        fixed[i] = self._cut_text(text)
                cut = pa.array(fixed, pa.large_string())
            texts = cut
        if self.rule == "drop":
            lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            lists = pc.split_pattern(texts, _CUT)
        bounds = lists.offsets.to_numpy()
        coded = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        units, codes = coded.dictionary, coded.indices.to_numpy()
        if self.rule == "drop":
            # Names of special tokens keep their case; all else is lowered anyway.
            named = pc.match_substring(units, "<|")
            lowered = pc.if_else(named, units, pc.ascii_lower(units)).dictionary_encode()
            units, codes = lowered.dictionary, lowered.indices.to_numpy()[codes]
        values, sizes = self._unit_ids(units)
        starts, lengths = np.cumsum(sizes) - sizes, sizes[codes]
        ids = ragged_take(values, starts[codes], lengths)
        reached = np.concatenate([[0], np.cumsum(lengths)])[bounds - bounds[0]]
        counts = np.diff(reached)
        if not whole:
            return ids, counts
        return self._with_whole(ids, counts, whole)

    def _with_whole(
        self, ids: np.ndarray, counts: np.ndarray, whole: dict[int, np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(counts)
        parts = []
        for i in range(len(counts)):
            parts.append(ids[ends[i] - counts[i] : ends[i]])
            if i in whole:
                parts[-1] = whole[i]
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


_TOKENIZERS: dict[str, TextTokenizer] = {}


def text_tokenizer(path: str) -> TextTokenizer:
    """One tokenizer per worker process and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = TextTokenizer(path)
    return _TOKENIZERS[path]


def with_end(
    ids: np.ndarray, counts: np.ndarray, end_id: int | None
) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with ``end_id`` after those of each text."""
    if end_id is None:
        return ids, counts
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    kept = np.ones(len(out), bool)
    kept[np.cumsum(counts + 1) - 1] = False
    out[kept] = ids
    return out, counts + 1
