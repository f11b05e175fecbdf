"""Column-level cleaning expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import text_of


# Shapes that text must have to be readable as a type at all.
EDGE = r"[\s\p{Cntrl}]*"
WHOLE_NUMBER = rf"^{EDGE}[+-]?[0-9]+{EDGE}$"
NUMBER = rf"^{EDGE}[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?{EDGE}$"
DATE = rf"^{EDGE}[+-]?[0-9]{{4,7}}(-[0-9]{{1,2}}){{0,2}}([ T].*)?{EDGE}$"


def text_cast(value: Column, target: T.DataType) -> Column:
    """``try_cast`` of text.

    A failing ``try_cast`` raises and catches an exception inside, which takes
    many times as long as a good one. Text without the right shape never gets there.
    """
    shape = None
    if isinstance(target, T.IntegralType):
        shape = WHOLE_NUMBER
    elif isinstance(target, T.DecimalType):
        shape = NUMBER
    elif isinstance(target, (T.DateType, T.TimestampNTZType)):
        shape = DATE
    cast = value.try_cast(target)
    return cast if shape is None else F.when(value.rlike(shape), cast)


def safe_cast(
    value: Column, target: T.DataType, default: Any = None, *, source: T.DataType | None = None
) -> Column:
    """Cast that turns unreadable values into the default instead of failing the job."""
    is_text = isinstance(source, T.StringType)
    result = text_cast(value, target) if is_text else value.try_cast(target)
    return result if default is None else F.coalesce(result, F.lit(default))


def filled_upper(value: Column, default: str) -> Column:
    """Upper-cased text, with the default (upper-cased as well) in place of null."""
    return F.upper(F.coalesce(value, F.lit(default)))


def guarded_ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` where the whole is positive, else 0.0."""
    whole = whole.cast("double")
    return F.when(F.coalesce(whole, F.lit(0.0)) > 0, part.cast("double") / whole).otherwise(0.0)


def always_fits(source: T.DataType, target: T.DataType) -> bool:
    """Whether every value of the one type has its place in the other."""
    if source == target or isinstance(target, T.StringType):
        return True
    small = (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType)
    if isinstance(target, T.LongType):
        return isinstance(source, small)
    if isinstance(target, T.DoubleType):
        return isinstance(source, (*small, T.LongType, T.FloatType))
    return False


def lossless_cast(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """Value in the target type, or null where the target cannot hold it.

    Whole numbers written as ``2026.0`` become integers; 2026.5 does not lose
    its half, it becomes null and is left to the castability rule.
    """
    if source == target:
        return value
    if isinstance(target, T.StringType):
        return text_of(value, source)
    is_text = isinstance(source, T.StringType)
    fractional = isinstance(source, (T.DoubleType, T.FloatType, T.DecimalType))
    if isinstance(target, T.IntegralType) and (is_text or fractional):
        decimal = T.DecimalType(38, 10)
        number = text_cast(value, decimal) if is_text else value.try_cast(decimal)
        whole = F.when(number == F.floor(number), number.try_cast(target))
        return F.coalesce(text_cast(value, target), whole) if is_text else whole
    if is_text:
        return text_cast(value, target)
    return value.try_cast(target)
