"""File inventory: listing, hashes, selection, grouping and skipping of known files."""

from __future__ import annotations

import fnmatch
import hashlib
import re
from collections.abc import Iterator, Sequence
from datetime import datetime

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# A larger file does not go through a binary cell: it is hashed block by block.
MAX_CELL_BYTES = 256 * 1024 * 1024
BLOCK_BYTES = 1024 * 1024

INVENTORY_COLUMNS = (
    "source_id",
    "path",
    "relative_path",
    "file_name",
    "suffix",
    "size_bytes",
    "modified_at",
    "created_at",
    "content_hash",
)


def plain_path(path: Column) -> Column:
    """One spelling for local paths, which Spark writes as file:/x and file:///x."""
    return F.regexp_replace(path, r"^file:/+", "/")


def metadata_path(path: Column) -> Column:
    """The same spelling for ``_metadata.file_path``, which is percent-encoded."""
    return plain_path(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))))


def matches_any(patterns: Sequence[str], *names: Column) -> Column:
    """Whether any name matches any shell pattern; ``*`` also crosses folders."""
    found = F.lit(False)
    for pattern in patterns:
        # \z anchors in both regex dialects; Python's own closing anchor is not Java's.
        regex = "^" + fnmatch.translate(pattern).replace(r"\Z", r"\z")
        for name in names:
            found = found | name.rlike(regex)
    return found


def list_files(
    spark: SparkSession,
    root: str,
    *,
    source_id: str = "",
    recursive: bool = False,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Files below ``root`` with sizes and times; contents are not read.

    Every regular file is listed, empty and hidden ones too; without ``recursive`` only
    those in the folder itself. A missing path fails here. Hadoop's file systems report
    no creation time, so the time of the last change stands in for it. As with any scan,
    the names of the files pass through the driver.
    """
    path, fs = _hadoop_path(spark, root)
    if not fs.exists(path):
        raise FileNotFoundError(f"Source path does not exist: {root}")
    if not fs.getFileStatus(path).isDirectory():
        raise NotADirectoryError(f"Source path must be a directory: {root}")
    found = []
    statuses = fs.listFiles(path, recursive)
    while statuses.hasNext():
        status = statuses.next()
        found.append(
            (status.getPath().toString(), status.getLen(), status.getModificationTime())
        )
    files = spark.createDataFrame(found, "path string, length long, changed long").select(
        plain_path(F.col("path")).alias("path"),
        "length",
        F.timestamp_millis("changed").alias("modificationTime"),
    )
    base = re.sub(r"^file:/+", "/", path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())
    base = base.rstrip("/")
    name = F.substring_index("path", "/", -1)
    relative = F.expr(f"substring(path, {len(base) + 2})")
    # A leading dot is part of the name and not the start of a suffix.
    suffix = F.lower(F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1))
    listed = files.select(
        F.lit(source_id).alias("source_id"),
        "path",
        relative.alias("relative_path"),
        name.alias("file_name"),
        suffix.alias("suffix"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.col("modificationTime").alias("created_at"),
    )
    return with_patterns(listed, include=include, exclude=exclude)


def with_patterns(
    files: DataFrame, *, include: Sequence[str] = (), exclude: Sequence[str] = ()
) -> DataFrame:
    """Files whose name or relative path matches an include and no exclude pattern."""
    names = F.col("file_name"), F.col("relative_path")
    if include:
        files = files.filter(matches_any(include, *names))
    if exclude:
        files = files.filter(~matches_any(exclude, *names))
    return files


def _hadoop_path(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def loadable(path: str) -> str:
    """A listed path as Spark's readers take it: with its scheme, and no part read as a pattern."""
    escaped = re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
    return f"file://{escaped}" if path.startswith("/") else escaped


def with_content_hash(files: DataFrame, *, max_cell_bytes: int = MAX_CELL_BYTES) -> DataFrame:
    """Add the SHA-256 of each file's bytes; only the given files are read.

    The binary source reads a file's content before it can look at its name,
    hence the explicit paths, which Spark's file index holds on the driver in any
    case. Large files are read in blocks by the task that gets their path, and so are
    those that Spark's sources pass over, which are empty or hidden.
    """
    spark = files.sparkSession
    passed_over = (F.col("size_bytes") == 0) | F.col("path").rlike(r"/[_.][^/]*$")
    in_blocks = (F.col("size_bytes") > max_cell_bytes) | passed_over
    large = files.filter(in_blocks).select("path")
    hashed = large.repartition("path").mapInPandas(_hash_blocks, "path string, content_hash string")
    small = files.filter(~in_blocks).select("path")
    paths = [loadable(r["path"]) for r in small.toLocalIterator()]
    if paths:
        content = spark.read.format("binaryFile").load(paths)
        by_cell = content.select(
            plain_path(F.col("path")).alias("path"), F.sha2("content", 256).alias("content_hash")
        )
        hashed = by_cell.unionByName(hashed)
    return files.join(hashed, "path")


def _hash_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hashes = []
        for path in batch["path"]:
            filesystem, inner = pafs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with filesystem.open_input_stream(inner) as stream:
                while block := stream.read(BLOCK_BYTES):
                    digest.update(block)
            hashes.append(digest.hexdigest())
        yield pd.DataFrame({"path": batch["path"], "content_hash": hashes})


def inventory(
    spark: SparkSession,
    root: str,
    *,
    source_id: str = "",
    recursive: bool = False,
    include: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Listed files with content hashes, by lower-cased path."""
    listed = list_files(
        spark, root, source_id=source_id, recursive=recursive, include=include, exclude=exclude
    )
    hashed = with_content_hash(listed)
    return hashed.select(*INVENTORY_COLUMNS).orderBy(F.lower("path"))


def select_all(files: DataFrame) -> DataFrame:
    return files


def select_latest(files: DataFrame) -> DataFrame:
    """The file changed last; of several, the one with the greatest path."""
    return files.orderBy(F.desc_nulls_last("modified_at"), F.desc("path")).limit(1)


def select_latest_per_source(files: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` files changed last of each source."""
    order = Window.partitionBy("source_id").orderBy(F.desc_nulls_last("modified_at"), F.desc("path"))
    return files.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def select_named(files: DataFrame, regex: str) -> DataFrame:
    """Files whose name matches the regular expression."""
    return files.filter(F.col("file_name").rlike(regex))


def select_changed_between(
    files: DataFrame, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Files changed from ``start`` on and before ``end``."""
    if start is not None:
        files = files.filter(F.col("modified_at") >= F.lit(start))
    if end is not None:
        files = files.filter(F.col("modified_at") < F.lit(end))
    return files


def skip_known(files: DataFrame, known: DataFrame, *, column: str = "content_hash") -> DataFrame:
    """Files whose content was not loaded before."""
    loaded = known.select(F.col(column).alias("content_hash"))
    return files.join(loaded, "content_hash", "left_anti").select(*files.columns)


def group_single(files: DataFrame) -> DataFrame:
    """All files of a source under one group id."""
    return files.withColumn("group_id", F.concat("source_id", F.lit("__single_group")))


def group_by_parent(files: DataFrame) -> DataFrame:
    """Files grouped by their folder."""
    parent = F.regexp_extract("relative_path", r"^(.*)/[^/]*$", 1)
    return files.withColumn("group_id", F.concat_ws("__", "source_id", parent))


def group_by_day(files: DataFrame) -> DataFrame:
    """Files grouped by the day of their last change."""
    return files.withColumn("group_id", F.concat_ws("__", "source_id", F.to_date("modified_at")))


def group_by_name(files: DataFrame, regex: str) -> DataFrame:
    """Files grouped by what the first group of the expression finds in their name."""
    return files.withColumn(
        "group_id", F.concat_ws("__", "source_id", F.regexp_extract("file_name", regex, 1))
    )


def group_summary(grouped: DataFrame) -> DataFrame:
    """Groups with their file counts and sizes. Members stay rows of ``grouped``."""
    return grouped.groupBy("group_id").agg(
        F.count("*").alias("asset_count"), F.sum("size_bytes").alias("total_bytes")
    )
