"""Sources of canonical tables made from folders of files."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.derive import Transform
from millrace.operators.shape import relaxed_union
from millrace.plans.jobs import Source
from millrace.scratch import Scratch
from millrace.sources.files import (
    list_files,
    loadable,
    select_all,
    skip_known,
    with_content_hash,
)
from millrace.sources.scan import query, scan, with_file_hash
from millrace.sources.schemas import file_columns, fold_schemas
from millrace.sources.sqlite import sqlite_query
from millrace.spec import SOURCE_FILE


def chosen_files(
    spark: SparkSession,
    scratch: Scratch,
    root: str,
    *,
    select: Callable[[DataFrame], DataFrame],
    known: DataFrame | None,
    **listing: Any,
) -> DataFrame:
    """Selected files with their hashes.

    Selection sees names, sizes and times; only what it leaves is read for its
    hash. ``known`` holds a ``content_hash`` column: files with these are skipped.
    """
    files = with_content_hash(select(list_files(spark, root, **listing)))
    if known is not None:
        files = skip_known(files, known)
    return scratch.stage(files, "selected-files")


def scan_alike(
    files: DataFrame,
    file_format: str,
    *,
    scratch: Scratch,
    schema: T.StructType | str | None = None,
    **options: Any,
) -> DataFrame:
    """Rows of files whose columns may differ in order, number and type.

    ``files`` has their paths in ``path``. With a schema, or for JSON, whose records name
    their fields, all files are one scan. Otherwise tasks look at headers and footers,
    and only distinct schemas come to the driver: delimited files with the same header
    are one scan, other files are one scan as long as no column has two types. Scans
    are united by name, files without content are left out.
    """
    spark = files.sparkSession
    if schema is not None or file_format == "json":
        paths = [loadable(r["path"]) for r in files.select("path").toLocalIterator()]
        return scan(spark, paths, file_format, schema=schema, **options)
    found = file_columns(files, file_format, scratch=scratch, options=options)
    found = scratch.stage(found, "file-columns")
    kinds = found.groupBy("columns").agg(F.min("path").alias("first")).orderBy("first").collect()
    if not kinds:
        return spark.createDataFrame([], T.StructType([T.StructField(SOURCE_FILE, T.StringType())]))
    number = {r["columns"]: i for i, r in enumerate(kinds)}
    paths: list[list[str]] = [[] for _ in kinds]
    # Spark's reader holds the paths of a scan on the driver in any case.
    for r in found.collect():
        paths[number[r["columns"]]].append(loadable(r["path"]))
    if file_format == "csv":
        return relaxed_union([scan(spark, group, file_format, **options) for group in paths])
    frames = []
    for members in fold_schemas([r["columns"] for r in kinds]):
        firsts = [loadable(kinds[i]["first"]) for i in members]
        reader = spark.read.format(file_format).options(**(options.get("options") or {}))
        united = reader.option("mergeSchema", "true").load(firsts).schema
        group = [path for i in members for path in paths[i]]
        frames.append(scan(spark, group, file_format, schema=united, **options))
    return relaxed_union(frames)


def file_source(
    source_id: str,
    root: str,
    file_format: str = "parquet",
    *,
    recursive: bool = False,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    select: Callable[[DataFrame], DataFrame] = select_all,
    known: DataFrame | None = None,
    sql: str | None = None,
    schema: T.StructType | str | None = None,
    read_options: Mapping[str, Any] | None = None,
    after_read: Sequence[Transform] = (),
) -> Source:
    """Files below ``root`` as a source: listed, selected, hashed, read and stamped.

    Without a schema, files with the same columns are one scan each, and the scans are
    united by name; files without any content are left out.
    ``sql`` is a statement with ``{source}`` for the rows read; it has to pass on
    ``_source_file`` to keep the provenance.
    """

    def read(spark: SparkSession) -> list[DataFrame]:
        scratch = Scratch(spark)
        files = chosen_files(
            spark,
            scratch,
            root,
            select=select,
            known=known,
            source_id=source_id,
            recursive=recursive,
            include=include,
            exclude=exclude,
        )
        if files.isEmpty():
            return []
        rows = scan_alike(
            files, file_format, scratch=scratch, schema=schema, **(read_options or {})
        )
        if sql is not None:
            rows = query(spark, sql, {"source": rows})
        return [with_file_hash(rows, files, scratch=scratch)]

    return Source(source_id, read, tuple(after_read))


def sqlite_source(
    source_id: str,
    root: str,
    sql: str,
    *,
    recursive: bool = False,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
    select: Callable[[DataFrame], DataFrame] = select_all,
    known: DataFrame | None = None,
    schema: T.StructType | str | None = None,
    split_column: str | None = None,
    splits: int = 1,
    after_read: Sequence[Transform] = (),
) -> Source:
    """The result of a statement on the selected SQLite files.

    With a schema all files are one scan. Without, each file is a frame of its
    own with the types found in it, and the frames are united.
    """

    def read(spark: SparkSession) -> list[DataFrame]:
        scratch = Scratch(spark)
        files = chosen_files(
            spark,
            scratch,
            root,
            select=select,
            known=known,
            source_id=source_id,
            recursive=recursive,
            include=include,
            exclude=exclude,
        )
        paths = [r["path"] for r in files.select("path").toLocalIterator()]
        if not paths:
            return []

        def rows_of(some: list[str]) -> DataFrame:
            return sqlite_query(
                spark,
                some,
                sql,
                schema=schema,
                split_column=split_column,
                splits=splits,
                source_column=SOURCE_FILE,
            )

        if schema is not None:
            return [with_file_hash(rows_of(paths), files, scratch=scratch)]
        united = relaxed_union([rows_of([path]) for path in paths])
        return [with_file_hash(united, files, scratch=scratch)]

    return Source(source_id, read, tuple(after_read))
