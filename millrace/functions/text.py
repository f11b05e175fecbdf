"""Text forms of typed columns, used by hashes, keys, ids and templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def double_text(value: Column) -> Column:
    """Text of a double as Python's ``str`` writes it.

    Spark writes ``1.0E7`` from ten million up and below a thousandth; Python
    stays with plain digits from 1e-4 up to 1e16 and pads its exponents.
    """
    native = value.cast("string")
    size = F.abs(value)

    def plain(digits_after_point: int) -> Column:
        digits = native.cast(T.DecimalType(38, digits_after_point)).cast("string")
        return F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", ".0")

    exponent = F.regexp_replace(
        F.regexp_replace(
            F.regexp_replace(F.regexp_replace(native, r"\.0E", "E"), r"E-(\d)$", "e-0$1"),
            r"E-(\d\d+)$",
            "e-$1",
        ),
        r"E(\d+)$",
        "e+$1",
    )
    return (
        F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), native)
        .when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when((size >= 1e7) & (size < 1e16), plain(10))
        .when((size >= 1e-4) & (size < 1e-3), plain(30))
        .otherwise(exponent)
    )


def text_of(value: Column, data_type: T.DataType) -> Column:
    """Text used in hashes and keys; null stays null."""
    if isinstance(data_type, T.DoubleType):
        return double_text(value)
    if isinstance(data_type, T.FloatType):
        return double_text(value.cast("string").cast("double"))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def display_text(value: Column, data_type: T.DataType) -> Column:
    """Text used in rendered templates and tags: as Python's ``str`` shows the value."""
    if isinstance(data_type, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        return F.when(F.date_format(value, "SSSSSS") == "000000", whole).otherwise(
            F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        )
    return text_of(value, data_type)


def column_text(df: DataFrame, name: str) -> Column:
    """``text_of`` for a named column of ``df``."""
    return text_of(F.col(f"`{name}`"), df.schema[name].dataType)


def column_display(df: DataFrame, name: str) -> Column:
    """``display_text`` for a named column of ``df``."""
    return display_text(F.col(f"`{name}`"), df.schema[name].dataType)


def json_field(df: DataFrame, name: str) -> Column:
    """A column as it goes into JSON: times, dates and decimals as their display text.

    Spark's own form of times has a ``T`` in it and, for zoned ones, an offset.
    """
    as_text = (T.TimestampType, T.TimestampNTZType, T.DateType, T.DecimalType)
    value = F.col(f"`{name}`")
    data_type = df.schema[name].dataType
    shown = display_text(value, data_type) if isinstance(data_type, as_text) else value
    return shown.alias(name)


def row_json(df: DataFrame, columns: Sequence[str]) -> Column:
    """JSON object of the columns in the given order, nulls included."""
    return F.to_json(
        F.struct(*[json_field(df, c) for c in columns]), {"ignoreNullFields": "false"}
    )
