"""Small helpers of the operators in this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of text that a task turns into arrays at a time.
SLICE_BYTES = 16 << 20


def named(column: str) -> Column:
    """A column by its literal name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_of(column: str) -> Column:
    """A text column without nulls: a null text counts as an empty one."""
    return F.coalesce(named(column), F.lit(""))


def byte_slices(
    batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """A batch in pieces whose texts have about ``size`` bytes; no row is cut."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(False)
    ends = np.cumsum(lengths, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        reached = ends[start] - lengths[start]
        stop = max(int(np.searchsorted(ends, reached + size, "right")), start + 1)
        yield batch.slice(start, stop - start)
        start = stop


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder, for files that are no Spark tables."""
    if "://" not in uri and not uri.startswith("file:"):
        store, path = fs.LocalFileSystem(), uri
    else:
        if uri.startswith("file:"):
            uri = "file:///" + uri.removeprefix("file:").lstrip("/")
        store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    store.create_dir(path, recursive=True)
    return store, path


def no_rows(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([], schema)
