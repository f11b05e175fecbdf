"""Token files with directly addressable codes.

An id is cut into chunks of eight bits, lowest first. The first level holds one
chunk of every id, the next level one chunk of every id that has more, and so on.
A bitmap beside each level marks the ids that continue; a rank directory counts its
ones before every block of 512. Any id can thus be read alone: follow its place from
level to level by rank, one byte a level, with no block to decode.

``write_token_files`` writes ids of whole texts to such files in the order of the
document ids, ``read_token_files`` reads all documents back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import byte_slices, open_folder
from millrace.llm.tokens import text_tokenizer, with_end
from millrace.scratch import Scratch

MAGIC = b"MRDAC001"
CHUNK_BITS = 8
RANK_BLOCK = 512

# Ids after which a task starts its next file; a longer document has a file to itself.
FILE_IDS = 8_000_000


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % 8)


def encode_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks, continuation bitmap (lowest bit first) and rank directory by level."""
    levels = []
    rest = np.asarray(ids, np.uint32)
    while len(rest) or not levels:
        more = rest >> CHUNK_BITS
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        blocks = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BLOCK), dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(blocks)[:-1]]) if len(rest) else np.zeros(0)
        levels.append(((rest & 255).astype(np.uint8), bitmap, ranks.astype("<u8")))
        rest = more[goes_on]
    return levels


class TokenFile:
    """One file: the ids, and the document ids with the end of each document."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("This is no file of directly addressable codes.")
        self.n_ids, self.n_documents, n_levels = np.frombuffer(data, "<u8", 3, 8).tolist()
        sizes = np.frombuffer(data, "<u8", n_levels, 32).tolist()
        self._at, self._data = 32 + 8 * n_levels, data
        self.document_ids = self._take("<i8", self.n_documents)
        self.id_known = self._take("u1", self.n_documents).astype(bool)
        self.ends = self._take("<i8", self.n_documents)
        self.levels = [
            (
                self._take("u1", n),
                self._take("u1", -(-n // 8)),
                self._take("<u8", -(-n // RANK_BLOCK)),
            )
            for n in sizes
        ]

    def _take(self, dtype: str, count: int) -> np.ndarray:
        found = np.frombuffer(self._data, dtype, count, self._at)
        self._at += found.nbytes + (-found.nbytes) % 8
        return found

    @staticmethod
    def pack(
        ids: np.ndarray, document_ids: np.ndarray, id_known: np.ndarray, ends: np.ndarray
    ) -> bytes:
        """The bytes of a file."""
        levels = encode_levels(ids)
        head = np.array([len(ids), len(ends), len(levels)], "<u8").tobytes()
        sizes = np.array([len(chunks) for chunks, _, _ in levels], "<u8").tobytes()
        arrays = [document_ids.astype("<i8"), id_known.astype("u1"), ends.astype("<i8")]
        arrays += [array for level in levels for array in level]
        return MAGIC + head + sizes + b"".join(_padded(array.tobytes()) for array in arrays)

    def get(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, each found by itself."""
        places = np.asarray(places, np.int64)
        values = np.zeros(len(places), np.uint32)
        open_ones = np.arange(len(places))
        shift = 0
        for chunks, bitmap, ranks in self.levels:
            values[open_ones] |= chunks[places].astype(np.uint32) << np.uint32(shift)
            goes_on = (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1
            open_ones, places = open_ones[goes_on], places[goes_on]
            if not len(places):
                break
            places, shift = self._rank(bitmap, ranks, places), shift + CHUNK_BITS
        return values

    @staticmethod
    def _rank(bitmap: np.ndarray, ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Ones before each place: the directory's count and those within the block."""
        block = places // RANK_BLOCK
        width = RANK_BLOCK // 8
        rows = block[:, None] * width + np.arange(width)
        bytes_ = np.where(rows < len(bitmap), bitmap[np.minimum(rows, len(bitmap) - 1)], 0)
        whole = np.arange(width) < ((places % RANK_BLOCK) >> 3)[:, None]
        inside = np.where(whole, np.bitwise_count(bytes_.astype(np.uint8)), 0).sum(1, dtype=np.int64)
        own = bitmap[places >> 3] & ((1 << (places & 7)) - 1).astype(np.uint8)
        return ranks[block].astype(np.int64) + inside + np.bitwise_count(own)

    def ids(self) -> np.ndarray:
        """All ids in a row."""
        values = np.zeros(0, np.uint32)
        for chunks, bitmap, _ in reversed(self.levels):
            found = chunks.astype(np.uint32)
            goes_on = np.unpackbits(bitmap, count=len(chunks), bitorder="little") == 1
            found[goes_on] |= values << np.uint32(CHUNK_BITS)
            values = found
        return values


def write_token_files(
    docs: DataFrame,
    folder: str,
    *,
    tokenizer: str,
    end_id: int | None,
    scratch: Scratch,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Write the ids of every whole text; return the list of files.

    The list has one row per file, in order: ``file_no``, ``path``, ``n_documents``,
    ``n_ids`` and ``start``, the ids in all files before it. Documents are in
    ascending order of their whole-number ids, null ids first; rows that share an id
    follow each other by text. A null text is an empty one; with ``end_id`` it has
    that one id. An empty table gives an empty list. Other columns are ignored.

    Tasks name files at random and the list is a committed table, so a file of a lost
    or repeated task is merely not listed.
    """
    rows = docs.select(
        F.col(f"`{id_column}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"),
    )
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = text_tokenizer(tokenizer)
        files, place = open_folder(folder)
        part, written = TaskContext.get().partitionId(), 0
        waiting: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def flush() -> pa.RecordBatch:
            nonlocal written
            ids = np.concatenate([w[0] for w in waiting])
            counts = np.concatenate([w[1] for w in waiting])
            docs_ = pa.chunked_array([w[2] for w in waiting], pa.int64())
            known = np.asarray(docs_.is_valid())
            data = TokenFile.pack(ids, np.asarray(docs_.fill_null(0)), known, np.cumsum(counts))
            path = f"{place}/{part:06d}-{written:04d}-{uuid4().hex}.dac"
            with files.open_output_stream(path) as out:
                out.write(data)
            row = [part, written, path, len(counts), len(ids)]
            written += 1
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in row], names=FILE_COLUMNS)

        for batch in batches:
            for piece in byte_slices(batch, "text"):
                ids, counts = with_end(*tokens.encode(piece.column("text")), end_id)
                waiting.append((ids, counts, piece.column("doc_id")))
                if sum(len(w[0]) for w in waiting) >= FILE_IDS:
                    yield flush()
        if waiting:
            yield flush()

    listed = scratch.stage(rows.mapInArrow(write, FILE_SCHEMA), "token-files")
    # One row per file of millions of ids.
    before = Window.orderBy("part", "file_in_part").rowsBetween(Window.unboundedPreceding, -1)
    return listed.select(
        F.row_number().over(Window.orderBy("part", "file_in_part")).alias("file_no"),
        "path",
        "n_documents",
        "n_ids",
        F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"),
    )


FILE_COLUMNS = ["part", "file_in_part", "path", "n_documents", "n_ids"]
FILE_SCHEMA = "part long, file_in_part long, path string, n_documents long, n_ids long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>"


def read_token_files(files: DataFrame, folder: str, *, with_ids: bool = True) -> DataFrame:
    """Every document in the listed files: ``doc_id``, ``start`` (ids of all documents
    before it), ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned
    32-bit integers) and, unless switched off, ``ids``.

    Files are read in a row; the last id of every document is also fetched by its place,
    and a file whose levels, bitmaps and ranks do not agree is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(row["path"]) as source:
                    file = TokenFile(source.read())
                ids = file.ids().astype("<u4")
                starts = np.concatenate([[0], file.ends[:-1]]).astype(np.int64)
                # The last id of each document once more, by its place alone.
                last = file.ends[file.ends > starts] - 1
                if (file.get(last) != ids[last]).any():
                    raise ValueError(f"'{row['path']}' does not read alike by place and in a row.")
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, file.ends)]
                columns = [
                    pa.array(file.document_ids, mask=~file.id_known),
                    pa.array(starts + row["start"]),
                    pa.array(file.ends - starts),
                    pa.array(sums, pa.int64()),
                ]
                if with_ids:
                    bounds = np.concatenate([starts, file.ends[-1:]]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = READ_SCHEMA if with_ids else READ_SCHEMA.rsplit(",", 1)[0]
    names = [field.split()[0] for field in schema.split(", ")]
    return files.repartition(max(files.count(), 1)).mapInArrow(read, schema)


