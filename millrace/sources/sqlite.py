"""Scan of SQLite files: a SQL statement per file, split into ranges of one column."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_ROWS = 10_000


@dataclass(frozen=True)
class FileRange(InputPartition):
    """The ``part``-th of ``parts`` equal ranges of the split column in one file."""

    path: str
    part: int
    parts: int


def _open(path: str) -> sqlite3.Connection:
    if not Path(path).exists():
        raise FileNotFoundError(f"SQLite source file not found: {path}")
    return sqlite3.connect(f"{Path(path).absolute().as_uri()}?mode=ro", uri=True)


class SqliteQuerySource(DataSource):
    """``spark.read.format("sqlite_query")``.

    Options: ``query``; ``paths`` (one per line, readable by every executor);
    ``splitColumn``, an integer column of the result such as a rowid, and
    ``numSplits``, into how many ranges of it each file is divided;
    ``sourceColumn``, a name under which to add the path of the file. Each task
    finds the bounds of its range itself; with an indexed column that is a
    lookup, as is the scan of its range.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_query"

    def schema(self) -> T.StructType:
        raise ValueError("State a schema, or use sqlite_query, which takes it from all rows.")

    def reader(self, schema: T.StructType) -> SqliteQueryReader:
        return SqliteQueryReader(schema, dict(self.options))


def _spark_type(kinds: set[str]) -> T.DataType:
    """Type for a column that holds values of these SQLite types; mixed ones become text."""
    kinds = kinds - {"null"}
    if kinds == {"integer"}:
        return T.LongType()
    if kinds and kinds <= {"integer", "real"}:
        return T.DoubleType()
    if kinds == {"blob"}:
        return T.BinaryType()
    return T.StringType()


class SqliteQueryReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.arrow_schema = to_arrow_schema(schema)
        self.query = options["query"]
        self.paths = options["paths"].splitlines()
        self.split_column = options.get("splitcolumn") or options.get("splitColumn")
        parts = options.get("numsplits") or options.get("numSplits") or "1"
        self.parts = int(parts) if self.split_column else 1
        self.adds_path = bool(options.get("sourcecolumn") or options.get("sourceColumn"))

    def partitions(self) -> Sequence[FileRange]:
        return [FileRange(p, i, self.parts) for p in self.paths for i in range(self.parts)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        connection = _open(partition.path)
        try:
            sql, bounds = self._range_sql(connection, partition)
            cursor = connection.execute(sql, bounds)
            added = (partition.path,) if self.adds_path else ()
            while rows := cursor.fetchmany(BATCH_ROWS):
                yield self.batch([row + added for row in rows] if added else rows)
        finally:
            connection.close()

    def _range_sql(
        self, connection: sqlite3.Connection, partition: FileRange
    ) -> tuple[str, tuple[int, ...]]:
        if partition.parts == 1:
            return self.query, ()
        name = '"' + self.split_column.replace('"', '""') + '"'
        bounds = f"SELECT min({name}), max({name}) FROM ({self.query})"
        low, high = connection.execute(bounds).fetchone()
        if low is None:
            low, high = 0, -1
        width = -(-(high - low + 1) // partition.parts)
        start = low + partition.part * width
        where = f"{name} >= ? AND {name} < ?"
        if partition.part == 0:
            where = f"({where}) OR {name} IS NULL"
        return f"SELECT * FROM ({self.query}) WHERE {where}", (start, start + width)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        arrays = []
        for position, field in enumerate(self.arrow_schema):
            values = [_fitting(row[position], field) for row in rows]
            arrays.append(pa.array(values, field.type))
        return pa.RecordBatch.from_arrays(arrays, schema=self.arrow_schema)


def _fitting(value: object, field: pa.Field) -> object:
    """A value as the column holds it; one that would be rounded or cut is an error."""
    if value is None:
        return None
    if pa.types.is_string(field.type) or pa.types.is_large_string(field.type):
        return value if isinstance(value, str) else _text(value)
    if pa.types.is_integer(field.type):
        fits = isinstance(value, int)
    elif pa.types.is_floating(field.type):
        fits = isinstance(value, float) or (isinstance(value, int) and float(value) == value)
        value = float(value) if fits else value
    else:
        return value
    if not fits:
        raise ValueError(f"Column '{field.name}' of type {field.type} cannot hold {value!r}.")
    return value


def _text(value: object) -> str:
    return value.decode("utf-8") if isinstance(value, bytes) else str(value)


def found_schema(spark: SparkSession, paths: Sequence[str], sql: str) -> T.StructType:
    """Types of the statement's columns, from all rows of all files.

    Each file's task lists the SQLite types of each column; a column without values
    is text.
    """
    inner = sql.strip().rstrip(";")
    connection = _open(paths[0])
    try:
        cursor = connection.execute(f"SELECT * FROM ({inner}) LIMIT 0")
        names = [d[0] for d in cursor.description]
    finally:
        connection.close()
    quoted = ['"' + name.replace('"', '""') + '"' for name in names]
    kinds = " UNION ".join(
        f"SELECT DISTINCT {i} AS place, typeof({name}) AS kind FROM ({inner})"
        for i, name in enumerate(quoted)
    )
    rows = sqlite_query(spark, paths, kinds, schema="place long, kind string")
    seen: list[set[str]] = [set() for _ in names]
    for place, kind in rows.distinct().collect():
        seen[place].add(kind)
    return T.StructType(
        [T.StructField(n, _spark_type(found)) for n, found in zip(names, seen, strict=True)]
    )


def sqlite_query(
    spark: SparkSession,
    paths: str | Sequence[str],
    sql: str,
    *,
    schema: T.StructType | str | None = None,
    split_column: str | None = None,
    splits: int = 1,
    source_column: str | None = None,
) -> DataFrame:
    """Rows of a SQL statement run on each of the SQLite files.

    ``source_column`` adds the path of the file under that name. Without a schema the
    types are those of all rows; a value that does not fit the schema stops the job.
    """
    if not sql or not sql.strip():
        raise ValueError("A query scan needs SQL.")
    paths = [paths] if isinstance(paths, str) else list(paths)
    spark.dataSource.register(SqliteQuerySource)
    if schema is None:
        schema = found_schema(spark, paths, sql)
    reader = spark.read.format("sqlite_query").option("query", sql.strip().rstrip(";"))
    reader = reader.option("paths", "\n".join(paths))
    if split_column:
        reader = reader.option("splitColumn", split_column).option("numSplits", str(splits))
    if source_column:
        reader = reader.option("sourceColumn", source_column)
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if source_column:
        declared = T.StructType([*declared, T.StructField(source_column, T.StringType())])
    return reader.schema(declared).load()
