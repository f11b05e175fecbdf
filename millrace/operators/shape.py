"""Row-wise shaping: provenance, unions, filling, cleaning and projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cleaning import filled_upper, lossless_cast, safe_cast
from millrace.functions.text import text_of
from millrace.spec import FILE_HASH, SOURCE_FILE, TableSpec
from millrace.spec import Column as DeclaredColumn

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def with_provenance(
    df: DataFrame, *, file_hash: str | None = None, source_file: str | None = None
) -> DataFrame:
    """Stamp the rows of one file with its hash and path."""
    return df.withColumns(
        {
            FILE_HASH: F.lit(file_hash or "unknown"),
            SOURCE_FILE: F.lit(source_file or "unknown"),
        }
    )


def supertype(left: T.DataType, right: T.DataType) -> T.DataType:
    """Type that holds the values of both; text when nothing else does."""
    if left == right:
        return left
    if isinstance(left, T.NullType):
        return right
    if isinstance(right, T.NullType):
        return left
    numbers = (*INTEGERS, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
    if isinstance(left, numbers) and isinstance(right, numbers):
        return _number_supertype(left, right)
    times = (T.DateType, T.TimestampNTZType)
    if isinstance(left, times) and isinstance(right, times):
        return T.TimestampNTZType()
    return T.StringType()


def _number_supertype(left: T.DataType, right: T.DataType) -> T.DataType:
    if isinstance(left, T.BooleanType):
        return right
    if isinstance(right, T.BooleanType):
        return left
    if isinstance(left, INTEGERS) and isinstance(right, INTEGERS):
        return max(left, right, key=lambda t: [type(t) is i for i in INTEGERS].index(True))
    if isinstance(left, (T.FloatType, T.DoubleType)) or isinstance(
        right, (T.FloatType, T.DoubleType)
    ):
        return T.DoubleType()
    as_decimals = [t if isinstance(t, T.DecimalType) else T.DecimalType(20, 0) for t in (left, right)]
    scale = max(t.scale for t in as_decimals)
    whole = max(t.precision - t.scale for t in as_decimals)
    return T.DecimalType(min(38, whole + scale), scale)


def relaxed_union(frames: Sequence[DataFrame | None]) -> DataFrame | None:
    """UNION ALL by name over frames whose columns and types may differ.

    Each column takes the supertype of its types before the union. Left to
    Spark, integer and text would meet as integer and fail on the first word.
    """
    present = [f for f in frames if f is not None]
    if not present:
        return None
    if len(present) == 1:
        return present[0]
    target: dict[str, T.DataType] = {}
    for frame in present:
        for f in frame.schema.fields:
            target[f.name] = supertype(target[f.name], f.dataType) if f.name in target else f.dataType

    def widened(frame: DataFrame) -> DataFrame:
        return frame.select(*[_widen(f, target[f.name]) for f in frame.schema.fields])

    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [widened(f) for f in present]
    )


def _widen(source: T.StructField, target: T.DataType) -> Column:
    value = F.col(f"`{source.name}`")
    if source.dataType == target:
        return value
    if isinstance(target, T.StringType):
        return text_of(value, source.dataType).alias(source.name)
    return value.cast(target).alias(source.name)


def fill_missing(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Add absent declared columns as their default, or as typed nulls where nullable."""
    absent = {
        c.name: F.lit(c.default).cast(c.data_type)
        for c in spec.all_columns
        if c.name not in df.columns and (c.default is not None or spec.nullable(c))
    }
    return df.withColumns(absent) if absent else df


def fill_required_defaults(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Put the default where a required column that has one is null."""
    filled = {
        c.name: F.coalesce(F.col(f"`{c.name}`"), F.lit(c.default).cast(df.schema[c.name].dataType))
        for c in spec.columns
        if c.name in df.columns and c.default is not None and not spec.nullable(c)
    }
    return df.withColumns(filled) if filled else df


def target_projection(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Exactly the declared and system columns, in declared order and stored type."""

    def stored(c: DeclaredColumn) -> Column:
        if c.name not in df.columns:
            return F.lit(None).cast(c.stored_type)
        declared = lossless_cast(F.col(f"`{c.name}`"), df.schema[c.name].dataType, c.data_type)
        return declared if c.stored_type == c.data_type else declared.cast(c.stored_type)

    return df.select(*[stored(c).alias(c.name) for c in spec.all_columns])


def dedupe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep one of the rows that agree on all of the columns.

    Repeated rows merge inside each map task, so a group of copies reaches the
    shuffle as at most one row per task.
    """
    present = [c for c in columns if c in df.columns]
    if set(present) == set(df.columns):
        return df.distinct()
    return df.dropDuplicates(present)


def clean(
    df: DataFrame,
    *,
    casts: Mapping[str, tuple[str, Any]] | None = None,
    uppers: Mapping[str, str] | None = None,
) -> DataFrame:
    """Safe casts with null defaults, and upper-cased text with null defaults."""
    changes: dict[str, Column] = {}
    for name, (data_type, default) in (casts or {}).items():
        source = df.schema[name].dataType
        target = T.DataType.fromDDL(data_type)
        changes[name] = safe_cast(F.col(f"`{name}`"), target, default, source=source)
    for name, default in (uppers or {}).items():
        changes[name] = filled_upper(F.col(f"`{name}`"), default)
    return df.withColumns(changes)


# The kinds of trades that are kept by default.
TRADE_TYPES = ("BUY", "SELL", "DIVIDEND", "BONUS")


def normalise_transactions(
    df: DataFrame,
    *,
    drop_zero_quantity: bool = True,
    uppercase_symbol: bool = True,
    trim_account_name: bool = True,
    allowed_types: Sequence[str] = TRADE_TYPES,
) -> DataFrame:
    """Tidy trades: no empty quantities, upper-case symbols, trimmed accounts, known types."""
    if uppercase_symbol:
        df = df.withColumn("symbol", F.upper("symbol"))
    if trim_account_name:
        df = df.withColumn("account_name", F.trim("account_name"))
    if drop_zero_quantity:
        df = df.filter(F.col("quantity") != 0)
    return df.filter(F.col("transaction_type").isin(*allowed_types))


def where_equal(df: DataFrame, **wanted: Any) -> DataFrame:
    """Rows equal to every given value; arguments that are None do not filter."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    return df
