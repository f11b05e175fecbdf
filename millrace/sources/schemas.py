"""What columns files have, read in tasks from their headers and footers."""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping, Sequence
from io import BytesIO
from typing import Any, BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.orc as orc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import Scratch
from millrace.sources.files import loadable, plain_path

HEADER_BYTES = 64 * 1024

FOUND = "path string, columns string, opened boolean"


def open_file(path: str) -> BinaryIO:
    """A listed file, opened by a task through Arrow's file systems."""
    if path.startswith("/"):
        return pafs.LocalFileSystem().open_input_file(path)
    store, inner = pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return store.open_input_file(inner)


def header_line(file: BinaryIO, encoding: str) -> str | None:
    """The first line of a delimited file that is not blank; None without one."""
    data = b""
    while True:
        block = file.read(HEADER_BYTES)
        data += block
        lines = data.decode(encoding, errors="replace").splitlines(keepends=True)
        for line in lines:
            ended = line.endswith(("\n", "\r")) or not block
            if line.strip() and ended:
                return line.rstrip("\r\n").removeprefix("\ufeff")
        if not block:
            return None


def footer_columns(file: BinaryIO, file_format: str) -> str:
    """Names and types of a file's columns as JSON, in the order of their names.

    Readers find columns by name, and a column that is required in one file and
    optional in another is the same column.
    """
    schema = orc.ORCFile(file).schema if file_format == "orc" else pq.ParquetFile(file).schema_arrow
    kinds = ((f.name, f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in schema)
    # Arrow's writers note a width of offsets that the file itself does not have.
    return json.dumps(sorted([name, str(kind).replace("large_", "")] for name, kind in kinds))


def _columns(file: BinaryIO, file_format: str, options: Mapping[str, Any]) -> str | None:
    if file_format != "csv":
        return footer_columns(file, file_format)
    if options.get("header_row") is False:
        return "" if file.read(1) else None
    return header_line(file, options.get("encoding") or "utf-8")


def file_columns(
    files: DataFrame,
    file_format: str,
    *,
    scratch: Scratch,
    options: Mapping[str, Any] | None = None,
) -> DataFrame:
    """``path`` and ``columns`` of files with content: the header line of delimited
    files, names and types of others.

    Tasks read no more than headers and footers. Files in a store that Arrow cannot
    open are read whole by Spark instead, in tasks as well.
    """
    options = dict(options or {})
    spark = files.sparkSession

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    file = open_file(path)
                except (OSError, pa.ArrowInvalid, pa.ArrowNotImplementedError):
                    found.append((path, None, False))
                    continue
                with file:
                    empty = file.size() == 0
                    columns = None if empty else _columns(file, file_format, options)
                found.append((path, columns, True))
            yield _batch(found)

    def look_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content")):
                file = BytesIO(data.as_buffer())
                found.append((path, _columns(file, file_format, options) if data.as_py() else None, True))
            yield _batch(found)

    # Many small reads, dealt out evenly.
    tasks = spark.sparkContext.defaultParallelism * 4
    found = scratch.stage(files.select("path").repartition(tasks).mapInArrow(look, FOUND), "columns")
    closed = [loadable(r["path"]) for r in found.filter("NOT opened").select("path").collect()]
    if closed:
        content = spark.read.format("binaryFile").load(closed)
        content = content.select(plain_path(F.col("path")).alias("path"), "content")
        inside = scratch.stage(content.mapInArrow(look_inside, FOUND), "columns-inside")
        found = found.filter("opened").unionByName(inside)
    return found.filter("columns IS NOT NULL").select("path", "columns")


def _batch(rows: list[tuple[str, str | None, bool]]) -> pa.RecordBatch:
    paths, columns, opened = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(paths, pa.string()), pa.array(columns, pa.string()), pa.array(opened, pa.bool_())],
        names=["path", "columns", "opened"],
    )


def fold_schemas(schemas: Sequence[str]) -> list[list[int]]:
    """Numbers of the schemas that one scan can read together, scan by scan.

    Each schema joins the first scan that holds none of its columns with another type;
    what a file lacks is null there. Schemas are those of ``file_columns``.
    """
    scans: list[tuple[dict[str, str], list[int]]] = []
    for number, schema in enumerate(schemas):
        columns = dict(json.loads(schema))
        for known, members in scans:
            if all(known.get(name, kind) == kind for name, kind in columns.items()):
                known.update(columns)
                members.append(number)
                break
        else:
            scans.append((columns, [number]))
    return [members for _, members in scans]
