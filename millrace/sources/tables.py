"""Stored tables: Parquet folders per write, made visible by a commit that names them."""

from __future__ import annotations

import json
import re
from collections.abc import Collection, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keys import key_bucket
from millrace.operators.lookups import planned_bytes
from millrace.operators.merge import full_key, key_collisions, merge_buckets
from millrace.operators.quality import duplicate_keys
from millrace.scratch import Scratch, several_open_files
from millrace.spec import TableSpec

BUCKET = "_bucket"
COMMIT_FILE = "commit.json"

# Parquet bytes a bucket is meant to hold: what one task merges in memory, where rows take
# many times their bytes in a file, and stored ones and the batch lie side by side.
BUCKET_BYTES = 32 * 1024 * 1024

# Where a plan has one of these, Spark's estimate of its size is no measurement.
UNMEASURED = re.compile(
    r"\b(Join|Aggregate|Generate|Expand|LogicalRDD|Sample|MapIn\w+|\w*Python\w*|\w*Pandas)\b"
)


class KeyCollision(ValueError):
    """An append brought keys that the table already holds."""


@dataclass(frozen=True)
class Commit:
    """State of a table: the number of its next version, its schema, live folders and bucketing."""

    next_version: int
    schema: T.StructType | None = None
    folders: tuple[str, ...] = ()
    buckets: int | None = None
    key: tuple[str, ...] = ()


@dataclass(frozen=True)
class LoadResult:
    table_name: str
    mode: str
    inserted_rows: int
    updated_rows: int

    @property
    def total_affected(self) -> int:
        return self.inserted_rows + self.updated_rows


def bucket_count(spec: TableSpec, *frames: DataFrame) -> int:
    """The specified number of buckets, or one that suits the size of the frames."""
    if spec.buckets:
        return spec.buckets
    return max(1, -(-sum(planned_bytes(f) for f in frames) // BUCKET_BYTES))


def measured(batch: DataFrame) -> DataFrame:
    """The batch with a size that is known: written out unless it is a plain scan."""
    plan = batch._jdf.queryExecution().optimizedPlan()
    if UNMEASURED.search(plan.toString()):
        return Scratch(batch.sparkSession).stage(batch, "batch")
    return batch


class TableStore:
    """Tables below one root folder, one writer at a time.

    A write goes to new folders ``data/_write=<n>/...`` and becomes visible when a commit
    naming all live folders is added to the table's commits, so readers see
    the table before or after a write and never in between, and a failed write
    leaves only files that nothing refers to.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    # Reading

    def _commit(self, name: str) -> Commit:
        """The newest commit.

        Each commit is a folder of its own and names all live folders, so only
        one is read. A folder that a lost writer left without content is passed
        over, and its number is not used again.
        """
        attempts = self._children(f"{self.root}/{name}/commits")
        following = int(attempts[-1].removeprefix("v=")) + 1 if attempts else 1
        for attempt in reversed(attempts):
            content = self._content(f"{self.root}/{name}/commits/{attempt}")
            if content:
                schema = T.StructType.fromJson(content["schema"])
                return Commit(
                    following,
                    schema,
                    tuple(content["folders"]),
                    content["buckets"],
                    tuple(content["key"]),
                )
        return Commit(following)

    def _file_system(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _content(self, attempt: str) -> dict | None:
        """What a commit says; none where its writer did not get to the end."""
        file, fs = self._file_system(f"{attempt}/{COMMIT_FILE}")
        if not fs.exists(file):
            return None
        stream = fs.open(file)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def version(self, name: str) -> int:
        """Number of the newest commit that says something; 0 without a table."""
        attempts = self._children(f"{self.root}/{name}/commits")
        for attempt in reversed(attempts):
            if self._content(f"{self.root}/{name}/commits/{attempt}"):
                return int(attempt.removeprefix("v="))
        return 0

    def changes(self, name: str, since: int) -> DataFrame | None:
        """What differs from an earlier version, as rows with a ``_sign``.

        Rows of folders that came have 1, those of folders that went have -1; a row
        that stayed but was written anew has both and cancels out. None where the
        earlier version cannot be compared: it never was, has other columns, its folders
        are deleted, or the folders to read are no fewer than those of the table.
        """
        then = self._content(f"{self.root}/{name}/commits/v={since:012d}") if since else None
        now = self._commit(name)
        if then is None or T.StructType.fromJson(then["schema"]) != now.schema:
            return None
        came = sorted(set(now.folders) - set(then["folders"]))
        gone = sorted(set(then["folders"]) - set(now.folders))
        if (came or gone) and len(came) + len(gone) >= len(now.folders):
            return None
        for folder in gone:
            path, fs = self._file_system(f"{self.root}/{name}/data/{folder}")
            if not fs.exists(path):
                return None
        signed = [
            self._read(name, now.schema, folders).withColumn("_sign", F.lit(sign))
            for folders, sign in ((came, 1), (gone, -1))
        ]
        return signed[0].unionByName(signed[1])

    def exists(self, name: str) -> bool:
        return self._commit(name).schema is not None

    def read(self, name: str) -> DataFrame:
        """The table as of its latest commit; an empty table keeps its columns."""
        commit = self._commit(name)
        if commit.schema is None:
            raise FileNotFoundError(f"Table '{name}' does not exist below {self.root}.")
        return self._read(name, commit.schema, commit.folders)

    def _read(self, name: str, schema: T.StructType, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        base = f"{self.root}/{name}/data"
        # Spark takes the folders of one scan to be partitioned alike.
        alike: dict[tuple[str, ...], list[str]] = {}
        for folder in folders:
            levels = tuple(part.split("=")[0] for part in folder.split("/"))
            alike.setdefault(levels, []).append(f"{base}/{folder}")
        scans = [
            self.spark.read.schema(schema).option("basePath", base).parquet(*group).select(*schema.names)
            for group in alike.values()
        ]
        return reduce(DataFrame.unionByName, scans)

    # Writing

    def _write(
        self,
        name: str,
        version: int,
        df: DataFrame,
        partition: str | None,
        sort: Sequence[str] = (),
    ) -> list[str]:
        """Write a new version; its folders, one per partition value."""
        folder, path = self._fresh(name, version)
        if sort:
            df = df.sortWithinPartitions(*([partition] if partition else []), *sort)
        if partition is None:
            df.write.parquet(path)
            return [folder]
        if partition == BUCKET:
            df.write.partitionBy(partition).parquet(path)
        else:
            with several_open_files(self.spark):
                df.write.partitionBy(partition).parquet(path)
        return [f"{folder}/{child}" for child in self._children(path) if "=" in child]

    def _fresh(self, name: str, version: int) -> tuple[str, str]:
        """A folder for a new version, and its path.

        The suffix keeps apart two writers that mistake themselves for the only one;
        the second of them then fails to publish.
        """
        folder = f"_write={version}-{uuid4().hex[:8]}"
        return folder, f"{self.root}/{name}/data/{folder}"

    def _children(self, path: str) -> list[str]:
        folder, fs = self._file_system(path)
        if not fs.exists(folder):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory())

    def _publish(
        self,
        name: str,
        version: int,
        schema: T.StructType,
        folders: Sequence[str],
        *,
        buckets: int | None = None,
        key: Sequence[str] = (),
    ) -> None:
        """Make a version visible. A version that exists already fails a second writer."""
        content = {
            "version": version,
            "schema": schema.jsonValue(),
            "folders": list(folders),
            "buckets": buckets,
            "key": list(key),
        }
        # The file system itself refuses to create a file that exists.
        file, fs = self._file_system(f"{self.root}/{name}/commits/v={version:012d}/{COMMIT_FILE}")
        try:
            stream = fs.create(file, False)
        except Py4JJavaError as problem:
            if fs.exists(file):
                raise FileExistsError(f"Version {version} of '{name}' exists already.") from problem
            raise
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()

    def write(
        self,
        spec: TableSpec,
        batch: DataFrame,
        mode: str | None = None,
        *,
        unique_keys: bool = False,
    ) -> LoadResult:
        """Load a batch that already has the table's columns.

        A batch that is no plain scan is written out first. Counts come
        from the written files, not from counters kept by running tasks, so
        repeated tasks cannot change them. Unless ``unique_keys`` vouches for it, keys
        are checked: an append or a replacement that repeats a key is refused, an
        upsert takes the row that is greatest by its columns in their order.
        """
        mode = mode or spec.load_mode
        declared = [(f.name, f.dataType) for f in spec.schema()]
        if [(f.name, f.dataType) for f in batch.schema] != declared:
            # Buckets are hashes of typed values: other types would miss stored keys.
            raise ValueError(f"Batch for '{spec.name}' does not have the columns of the table.")
        if spec.key:
            batch = measured(batch)
        if spec.key and not unique_keys:
            batch = self._unique(spec, batch, mode)
        if mode == "append":
            return self._append(spec, batch)
        if mode == "replace":
            return self._replace(spec, batch)
        if mode == "upsert":
            return self._upsert(spec, batch)
        raise ValueError(f"Unsupported write mode: {mode}")

    def _unique(self, spec: TableSpec, batch: DataFrame, mode: str) -> DataFrame:
        """The batch with one row per full key; a null part of a key matches nothing."""
        full = batch.filter(full_key(spec.key))
        if duplicate_keys(full, spec.key).isEmpty():
            return batch
        if mode != "upsert":
            raise KeyCollision(f"The batch for '{spec.name}' repeats keys {spec.key}.")
        row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
        last = full.groupBy(*spec.key).agg(F.max(row).alias("last")).select("last.*")
        one = last.select(*batch.columns).unionByName(batch.filter(~full_key(spec.key)))
        return Scratch(self.spark).stage(one, "batch")

    def _bucketed(self, spec: TableSpec, batch: DataFrame, buckets: int) -> DataFrame:
        if not spec.key:
            return batch
        return batch.withColumn(BUCKET, key_bucket(batch, spec.key, buckets))

    def _fitting_commit(self, spec: TableSpec, batch: DataFrame) -> tuple[Commit, int]:
        """The newest commit and the bucket count to go on with.

        A stored table keeps its bucket count as long as any of its buckets stay:
        with another count their keys would be looked for in the wrong place.
        """
        commit = self._commit(spec.name)
        if not commit.folders:
            return commit, bucket_count(spec, batch)
        stored = [(f.name, f.dataType) for f in commit.schema]
        if stored != [(f.name, f.dataType) for f in batch.schema] or commit.key != tuple(spec.key):
            raise ValueError(f"Table '{spec.name}' is stored with other columns or another key.")
        return commit, commit.buckets or 1

    def _write_rows(self, spec: TableSpec, version: int, rows: DataFrame) -> list[str]:
        partition = BUCKET if spec.key else None
        # Spark sizes the writing tasks by what the buckets hold: a large one is
        # written by several tasks, small ones share a task.
        spread = rows.hint("rebalance", partition) if partition else rows
        return self._write(spec.name, version, spread, partition, spec.indexed_names)

    def _nullable_key(self, spec: TableSpec) -> bool:
        return any(spec.nullable(c) for c in spec.columns if c.name in spec.key)

    def _touched(self, bucketed: DataFrame, folders: Sequence[str]) -> set[str]:
        """Live folders of the buckets the batch has rows for: one value per bucket at most."""
        names = {f"{BUCKET}={r[0]}" for r in bucketed.select(BUCKET).distinct().collect()}
        return {f for f in folders if f.split("/")[-1] in names}

    def _append(self, spec: TableSpec, batch: DataFrame) -> LoadResult:
        commit, buckets = self._fitting_commit(spec, batch)
        rows = self._bucketed(spec, batch, buckets)
        if spec.key and commit.folders:
            touched = sorted(self._touched(rows, commit.folders))
            stored = self._read(spec.name, commit.schema, touched)
            if not key_collisions(stored, batch, spec.key).isEmpty():
                raise KeyCollision(f"Append to '{spec.name}' repeats stored keys {spec.key}.")
        new = self._write_rows(spec, commit.next_version, rows)
        self._publish_rows(spec, commit.next_version, batch, [*commit.folders, *new], buckets)
        return LoadResult(spec.name, "append", self._count(spec.name, batch.schema, new), 0)

    def _replace(self, spec: TableSpec, batch: DataFrame) -> LoadResult:
        version = self._commit(spec.name).next_version
        buckets = bucket_count(spec, batch)
        new = self._write_rows(spec, version, self._bucketed(spec, batch, buckets))
        self._publish_rows(spec, version, batch, new, buckets)
        return LoadResult(spec.name, "replace", self._count(spec.name, batch.schema, new), 0)

    def _upsert(self, spec: TableSpec, batch: DataFrame) -> LoadResult:
        """Merge into the buckets the batch touches; other buckets are not read or written."""
        commit, buckets = self._fitting_commit(spec, batch)
        arriving = batch.count()
        if arriving == 0 and commit.schema is not None:
            return LoadResult(spec.name, "upsert", 0, 0)
        if not spec.key:
            appended = self._append(spec, batch)
            return LoadResult(spec.name, "upsert", appended.inserted_rows, 0)
        rows = self._bucketed(spec, batch, buckets)
        touched = self._touched(rows, commit.folders) if commit.folders else set()
        if touched:
            stored = self._read(spec.name, commit.schema, sorted(touched))
            held = len({f.split("/")[-1] for f in touched})
            if len(touched) == len(commit.folders):
                # All is written anew anyway: the time to follow the table's growth.
                held = buckets = max(buckets, bucket_count(spec, stored, batch))
            # A stated number of buckets, or one kept while the table grew, makes larger ones.
            size = planned_bytes(stored) + planned_bytes(batch)
            merged = merge_buckets(
                self._bucketed(spec, stored, buckets),
                self._bucketed(spec, batch, buckets),
                spec.key,
                BUCKET,
                nullable_key=self._nullable_key(spec),
                n_buckets=buckets,
                parts=max(1, -(-size // (held * BUCKET_BYTES))),
            )
            new = self._write(spec.name, commit.next_version, merged, BUCKET, spec.indexed_names)
        else:
            new = self._write_rows(spec, commit.next_version, rows)
        kept = [f for f in commit.folders if f not in touched]
        self._publish_rows(spec, commit.next_version, batch, [*kept, *new], buckets)
        # Every stored key that the batch repeats is one row fewer in the result.
        updated = 0
        if touched:
            before = self._count(spec.name, batch.schema, sorted(touched))
            updated = before + arriving - self._count(spec.name, batch.schema, new)
        return LoadResult(spec.name, "upsert", arriving - updated, updated)

    def _publish_rows(
        self, spec: TableSpec, version: int, batch: DataFrame, folders: Sequence[str], buckets: int
    ) -> None:
        self._publish(
            spec.name,
            version,
            batch.schema,
            folders,
            buckets=buckets if spec.key else None,
            key=spec.key,
        )

    def _count(self, name: str, schema: T.StructType, folders: Sequence[str]) -> int:
        """Rows in the folders; Parquet answers from its file footers."""
        return self._read(name, schema, folders).count() if folders else 0

    def replace_partition(self, name: str, df: DataFrame, partition: str, value: str) -> bool:
        """Make ``df`` the whole content of one partition value; says whether it did.

        Without any rows nothing is changed: dropping a partition is a call of its own.
        """
        commit = self._commit(name)
        new = self._write(name, commit.next_version, df, partition)
        if new:
            kept = [f for f in commit.folders if not _holds(f, value)]
            self._publish(name, commit.next_version, df.schema, [*kept, *new])
        return bool(new)

    def partition_folders(self, name: str, value: str) -> list[str]:
        """Live folders of one partition value."""
        return [f for f in self._commit(name).folders if _holds(f, value)]

    def replace_buckets(
        self, name: str, df: DataFrame, partition: str, gone: Collection[str]
    ) -> dict[int, str]:
        """Write buckets of one partition value in place of the folders in ``gone``.

        ``df`` has its bucket in ``_bucket``. Folders that are not named stay as they are;
        the new folder of each bucket is returned.
        """
        commit = self._commit(name)
        folder, path = self._fresh(name, commit.next_version)
        df.hint("rebalance", BUCKET).write.partitionBy(partition, BUCKET).parquet(path)
        new = {}
        for outer in self._children(path):
            for inner in self._children(f"{path}/{outer}"):
                new[int(inner.split("=")[1])] = f"{folder}/{outer}/{inner}"
        kept = [f for f in commit.folders if f not in gone]
        schema = T.StructType([f for f in df.schema if f.name != BUCKET])
        self._publish(name, commit.next_version, schema, [*kept, *new.values()])
        return new

    def drop_partition(self, name: str, value: str) -> int:
        """Remove one partition value; returns the number of rows it held."""
        commit = self._commit(name)
        gone = [f for f in commit.folders if _holds(f, value)]
        if not gone:
            return 0
        removed = self._count(name, commit.schema, gone)
        kept = [f for f in commit.folders if f not in gone]
        self._publish(name, commit.next_version, commit.schema, kept)
        return removed

    def rewrite(self, name: str, df: DataFrame, partition: str | None = None) -> None:
        """Make ``df``, which may come from the table itself, the whole content of a table."""
        commit = self._commit(name)
        new = self._write(name, commit.next_version, df, partition)
        self._publish(name, commit.next_version, df.schema, new)

    def append_rows(self, name: str, df: DataFrame, partition: str | None = None) -> None:
        """Append to a table without a key."""
        commit = self._commit(name)
        new = self._write(name, commit.next_version, df, partition)
        self._publish(name, commit.next_version, df.schema, [*commit.folders, *new])

    def _leaves(self, base: str, folder: str) -> list[str]:
        """Folders of the innermost partition level below a written folder."""
        below = [f"{folder}/{c}" for c in self._children(f"{base}/{folder}") if "=" in c]
        return [leaf for c in below for leaf in self._leaves(base, c) or [c]]

    def remove_dead(self, name: str) -> int:
        """Delete the folders of versions the latest commit no longer names.

        For use when no reader of an older version is left.
        """
        live = set(self._commit(name).folders)
        base = f"{self.root}/{name}/data"
        removed = 0
        for written in self._children(base):
            parts = self._leaves(base, written)
            for folder in parts or [written]:
                if folder not in live:
                    path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{folder}")
                    path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
                    removed += 1
        return removed


def _holds(folder: str, value: str) -> bool:
    """Whether a folder is one of a partition value; Spark percent-encodes names."""
    levels = folder.split("/")
    return len(levels) > 1 and unquote(levels[1].split("=", 1)[1]) == value
