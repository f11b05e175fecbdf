"""Scans of files by format, and SQL over what was scanned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.lookups import join_lookup
from millrace.scratch import Scratch
from millrace.sources.files import metadata_path
from millrace.spec import FILE_HASH, SOURCE_FILE

FORMATS = ("parquet", "csv", "json", "orc")


def scan(
    spark: SparkSession,
    paths: str | Sequence[str],
    file_format: str = "parquet",
    *,
    schema: T.StructType | str | None = None,
    delimiter: str | None = None,
    encoding: str | None = None,
    header_row: bool | None = None,
    options: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Rows of the files plus the ``_source_file`` each row came from."""
    if file_format not in FORMATS:
        raise ValueError(f"Unknown file format '{file_format}'.")
    reader = spark.read.format(file_format)
    if schema is not None:
        reader = reader.schema(schema)
    if file_format == "csv":
        reader = reader.option("header", "true" if header_row is None else str(header_row).lower())
        if delimiter is not None:
            reader = reader.option("delimiter", delimiter)
    if encoding is not None:
        reader = reader.option("encoding", encoding)
    for name, value in (options or {}).items():
        reader = reader.option(name, value)
    df = reader.load([paths] if isinstance(paths, str) else list(paths))
    return df.withColumn(SOURCE_FILE, metadata_path(F.col("_metadata.file_path")))


def query(spark: SparkSession, sql: str, frames: Mapping[str, DataFrame]) -> DataFrame:
    """Run a SQL statement over named frames.

    ``{name}`` in the statement stands for a frame. The frames get view names of
    their own, so that queries in one session cannot disturb each other.
    """
    if not sql or not sql.strip():
        raise ValueError("A query scan needs SQL.")
    views = {}
    for name, frame in frames.items():
        views[name] = f"{name}_{uuid4().hex}"
        frame.createOrReplaceTempView(views[name])
    try:
        return spark.sql(sql.format(**views))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def with_file_hash(df: DataFrame, files: DataFrame, *, scratch: Scratch) -> DataFrame:
    """Add the content hash of each row's source file from the inventory.

    The lookup join broadcasts the hashes as long as they are small, and otherwise
    keeps files with very many rows from meeting in one task.
    """
    lookup = scratch.stage(
        files.select(F.col("path").alias(SOURCE_FILE), F.col("content_hash").alias(FILE_HASH)),
        "file-hashes",
    )
    joined = join_lookup(df, lookup, [SOURCE_FILE], scratch=scratch)
    return joined.select(
        *[c for c in df.columns if c != SOURCE_FILE],
        F.coalesce(FILE_HASH, F.lit("unknown")).alias(FILE_HASH),
        F.coalesce(SOURCE_FILE, F.lit("unknown")).alias(SOURCE_FILE),
    )
