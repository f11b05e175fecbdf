"""Chat formatting by columnar byte assembly.

A batch of turns becomes one buffer: the lengths of all segments give their places,
and headers, roles and contents are copied there in one scatter each. Consecutive
turns of a conversation form a row, a piece; a conversation that crosses a batch or
a task has several. ``read_turns`` takes the pieces apart again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, named, text_of

START, END = "<|im_start|>", "<|im_end|>"

PIECE_SCHEMA = (
    "conv_id long, part long, piece long, n_turns long, formatted string, "
    "loss_spans array<struct<start:int,stop:int>>"
)
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_MARK = re.compile(r"\\(.)")


def escape(texts: pa.Array) -> pa.Array:
    """Texts without control strings: a backslash parts each ``<`` from its ``|``."""
    return pc.replace_substring_regex(texts, r"<(\\*)\|", r"<\1\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(roles: pa.Array) -> pa.Array:
    """Roles in one line, without control strings."""
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE_MARK.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in a row, and the length of each text."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], np.diff(offsets)


def _scatter(out: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
    """Copy consecutive segments of ``data`` to their places."""
    places = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out[places + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, the length of each turn, the place of its content."""
    role_bytes, role_sizes = _bytes_of(escape_role(roles))
    text_bytes, text_sizes = _bytes_of(escape(texts))
    head, middle, tail = START.encode(), b"\n", END.encode() + b"\n"
    sizes = len(head) + role_sizes + len(middle) + text_sizes + len(tail)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    n = len(sizes)
    at = starts
    for fixed, data, lengths in (
        (head, role_bytes, role_sizes),
        (middle, text_bytes, text_sizes),
        (tail, np.zeros(0, np.uint8), np.zeros(n, np.int64)),
    ):
        marks = np.tile(np.frombuffer(fixed, np.uint8), n)
        _scatter(out, marks, at, np.full(n, len(fixed)))
        at = at + len(fixed)
        _scatter(out, data, at, lengths)
        at = at + lengths
    return out, sizes, starts + len(head) + role_sizes + len(middle)


def format_chats(
    turns: DataFrame,
    *,
    loss_role: str = "assistant",
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """Pieces of formatted conversations, in the order of ``conv_id, part, piece``.

    ``formatted`` is the text, ``loss_spans`` the contents of turns of ``loss_role`` as
    byte ranges of its UTF-8 form. Turns are in ascending order, null turns first, and
    by role and text where a turn number repeats; all are kept. A null text is an
    empty one, and so is a null role; a null id is a conversation of its own. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = turns.select(
        named(id_column).cast("long").alias("conv_id"),
        named(turn_column).alias("turn"),
        text_of(role_column).alias("role"),
        text_of(text_column).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, written = TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                yield _pieces(batch, part, written, loss_role)
                written += batch.num_rows

    return rows.mapInArrow(write, PIECE_SCHEMA)


def _pieces(batch: pa.RecordBatch, part: int, written: int, loss_role: str) -> pa.RecordBatch:
    out, sizes, contents = assemble(batch.column("role"), batch.column("text"))
    ids = batch.column("conv_id")
    known = np.asarray(ids.is_valid())
    values = np.asarray(ids.fill_null(0))
    changes = (values[1:] != values[:-1]) | (known[1:] != known[:-1])
    first = np.concatenate([[0], np.flatnonzero(changes) + 1])
    n_turns = np.diff(np.append(first, len(values)))
    ends = np.cumsum(sizes)
    bounds = np.append(ends[first] - sizes[first], ends[-1])
    piece_of = np.repeat(np.arange(len(first)), n_turns)
    in_loss = np.asarray(pc.equal(batch.column("role"), loss_role))
    tail = len(END.encode()) + 1
    starts = (contents - bounds[piece_of])[in_loss]
    stops = (ends - tail - bounds[piece_of])[in_loss]
    span_ends = np.cumsum(np.bincount(piece_of[in_loss], minlength=len(first)))
    spans = pa.StructArray.from_arrays(
        [pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], ["start", "stop"]
    )
    text = pa.Array.from_buffers(
        pa.large_string(), len(first), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)]
    )
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(first)),
            pa.array(np.full(len(first), part)),
            pa.array(first + written),
            pa.array(n_turns),
            text.cast(pa.string()),
            pa.ListArray.from_arrays(np.append(0, span_ends).astype(np.int32), spans),
        ],
        names=["conv_id", "part", "piece", "n_turns", "formatted", "loss_spans"],
    )


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a piece."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def loss_texts(formatted: str, spans: list[dict]) -> list[str]:
    """The texts under the loss mask of a piece."""
    data = formatted.encode()
    return [unescape(data[s["start"] : s["stop"]].decode()) for s in spans]


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
    "formatted_chars long"
)


def chat_digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation, read from its pieces: turns, digests, lengths.

    The pieces of a conversation are read one after another and never held together.
    """
    rows = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [field.split()[0] for field in DIGEST_SCHEMA.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        schema = pa.schema(list(zip(names, types)))
        now, state = None, None

        def row() -> list:
            conv, turns, text_sha, loss, loss_sha, chars = state
            return [conv, turns, text_sha.hexdigest(), loss, loss_sha.hexdigest(), chars]

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != now:
                    if state is not None:
                        done.append(row())
                    now = r["conv_id"]
                    state = [now, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(r["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for text in loss_texts(r["formatted"], r["loss_spans"]):
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(r["formatted"])
            if done:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*done), types)], schema=schema
                )
        if state is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row(), types)], schema=schema
            )

    return rows.mapInArrow(digest, DIGEST_SCHEMA)
