"""Record hashes, concatenated keys and key buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import column_text

# Names a record hash leaves out unless told otherwise.
UNHASHED_COLUMNS = ("_file_hash", "_source_file", "_loaded_at", "_record_hash")


def joined_text(df: DataFrame, columns: Sequence[str], separator: str) -> Column:
    """Texts of the columns in the given order, nulls as empty text."""
    # concat_ws alone would drop nulls and let ('a', null) equal ('a').
    return F.concat_ws(separator, *[F.coalesce(column_text(df, c), F.lit("")) for c in columns])


def record_hash(
    df: DataFrame, columns: Sequence[str], *, separator: str = "||", length: int = 64
) -> Column:
    """SHA-256 hex over those of ``columns`` that ``df`` has, in the given order."""
    present = [c for c in columns if c in df.columns]
    digest = F.sha2(joined_text(df, present, separator), 256)
    return digest if length >= 64 else F.substring(digest, 1, length)


def with_record_hash(
    df: DataFrame, columns: Sequence[str], *, target: str = "_record_hash", length: int = 64
) -> DataFrame:
    """Add a record hash; a frame with none of the columns is left as it is."""
    if not any(c in df.columns for c in columns):
        return df
    return df.withColumn(target, record_hash(df, columns, length=length))


def hash_all_columns(
    df: DataFrame,
    *,
    target: str = "_record_hash",
    exclude: Sequence[str] = UNHASHED_COLUMNS,
) -> DataFrame:
    """Transform: hash every column of the frame but the excluded ones."""
    columns = [c for c in df.columns if c not in set(exclude)]
    return df.withColumn(target, record_hash(df, columns, separator="|"))


def concat_key(
    df: DataFrame, columns: Sequence[str], target: str, *, separator: str = "_"
) -> DataFrame:
    """Transform: one text key out of several columns."""
    return df.withColumn(target, joined_text(df, columns, separator))


def prefixed_id(
    df: DataFrame, columns: Sequence[str], target: str, *, prefix: str = "INV", separator: str = "-"
) -> DataFrame:
    """Transform: business id made of a literal prefix and the texts of the columns."""
    return df.withColumn(
        target, F.concat(F.lit(prefix + separator), joined_text(df, columns, separator))
    )


def key_bucket(df: DataFrame, key: Sequence[str], buckets: int) -> Column:
    """Storage bucket of a row.

    Rows without a full key never match anything, so they are spread by their
    whole content instead of all landing in the bucket of the null key.
    """
    has_key = F.lit(True)
    for name in key:
        has_key = has_key & F.col(f"`{name}`").isNotNull()
    by_key = F.xxhash64(*[F.col(f"`{c}`") for c in key])
    by_row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return F.pmod(F.when(has_key, by_key).otherwise(by_row), F.lit(buckets)).cast("int")
