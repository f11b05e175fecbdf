"""Staged tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one on a single machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors can reach.")
    return tempfile.mkdtemp(prefix="millrace-")


# Few enough to be held open by one task at the same time.
FEW_FILES = 8


@contextmanager
def several_open_files(spark: SparkSession) -> Iterator[None]:
    """Let a task write a few partition values side by side.

    Otherwise Spark sorts all rows by the partition columns before it writes them.
    With more values than this a task goes back to sorting.
    """
    option = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(option)
    spark.conf.set(option, str(FEW_FILES))
    try:
        yield
    finally:
        spark.conf.set(option, before)


class Scratch:
    """Writes intermediate results as Parquet and reads them back.

    A staged table ends the lineage, survives the loss of executors, is computed
    once however often it is read, and has a size the planner knows exactly,
    which is what its choice of broadcast joins rests on.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = f"{folder or shared_folder(spark)}/run-{uuid4().hex}"
        self._tables = 0

    def path(self, label: str) -> str:
        """A path not handed out before."""
        self._tables += 1
        return f"{self.folder}/{self._tables:04d}-{label}"

    def stage(
        self, df: DataFrame, label: str = "table", partition_by: Sequence[str] = ()
    ) -> DataFrame:
        """The same rows, read back from a written table."""
        path = self.path(label)
        with several_open_files(self.spark):
            df.write.partitionBy(*partition_by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def clear(self) -> None:
        """Delete what this object staged; frames read from it are unusable afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
