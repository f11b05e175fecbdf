"""Row rules, quarantine and reports on what was rejected."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cleaning import always_fits, lossless_cast, text_cast
from millrace.functions.text import row_json
from millrace.operators.lookups import HOT_ROWS, join_lookup
from millrace.operators.shape import where_equal
from millrace.scratch import Scratch
from millrace.spec import TableSpec

# Names of the two columns that flagged frames carry, and the messages.
ERROR_TEXT = "__error_messages__"
ERROR_FLAG = "__has_error__"
REQUIRED_ERROR = "Column '{}' is required but null."
DUPLICATE_ERROR = "Duplicate primary key on columns {}."
DEFAULT_ERROR = "Row failed validation."
SEPARATOR = "; "


@dataclass(frozen=True)
class Rule:
    """A row fails the rule where ``fails`` is true; ``fails`` null means it passes."""

    message: str
    fails: Column

    def __post_init__(self) -> None:
        if SEPARATOR in self.message:
            raise ValueError(f"A message must not contain '{SEPARATOR}', which parts messages.")


def required_rules(df: DataFrame, spec: TableSpec) -> list[Rule]:
    return [
        Rule(REQUIRED_ERROR.format(c.name), F.col(f"`{c.name}`").isNull())
        for c in spec.columns
        if c.name in df.columns and not spec.nullable(c) and c.default is None
    ]


def castable_rules(df: DataFrame, spec: TableSpec) -> list[Rule]:
    """Values that the declared type cannot hold."""
    rules = []
    for c in spec.columns:
        if c.name not in df.columns or always_fits(df.schema[c.name].dataType, c.data_type):
            continue
        value = F.col(f"`{c.name}`")
        lost = lossless_cast(value, df.schema[c.name].dataType, c.data_type).isNull()
        rules.append(Rule(f"Column '{c.name}' is not a valid {c.type}.", value.isNotNull() & lost))
    return rules


def allowed_values(name: str, values: Sequence[object]) -> Rule:
    return Rule(f"Column '{name}' has a value that is not allowed.", ~F.col(f"`{name}`").isin(*values))


def non_negative(name: str) -> Rule:
    return Rule(f"Column '{name}' is negative.", F.col(f"`{name}`") < 0)


def parsable_date(name: str, pattern: str | None = None) -> Rule:
    value = F.col(f"`{name}`").cast("string")
    parsed = F.try_to_timestamp(value, F.lit(pattern)) if pattern else text_cast(value, T.DateType())
    return Rule(f"Column '{name}' is not a date.", value.isNotNull() & parsed.isNull())


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with their row counts; nulls compare equal."""
    return df.groupBy(*key).agg(F.count("*").alias("_copies")).filter(F.col("_copies") > 1)


def mark_duplicates(
    df: DataFrame,
    key: Sequence[str],
    *,
    scratch: Scratch,
    flag: str = "_duplicated",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Flag every row of a key that occurs more than once.

    Only keys are shuffled to find the repeated ones, and counts combine before
    that shuffle. The repeated keys are staged, so their size decides how they
    get back to the rows: broadcast when small, else by a shuffle that leaves
    out the keys with very many copies.
    """
    repeated = scratch.stage(duplicate_keys(df, key), "repeated-keys")
    marked = repeated.select(*key, F.lit(True).alias(flag))
    hot = repeated.filter(F.col("_copies") >= hot_rows).select(*key)
    joined = join_lookup(df, marked, key, scratch=scratch, null_safe=True, hot=hot)
    return joined.withColumn(flag, F.coalesce(flag, F.lit(False)))


def duplicate_message(key: Sequence[str]) -> str:
    return DUPLICATE_ERROR.format(list(key))


def apply_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the joined messages of the failed rules and the error flag."""
    messages = [F.when(r.fails, F.lit(r.message)) for r in rules]
    text = F.concat_ws(SEPARATOR, *messages) if messages else F.lit("")
    return df.withColumn(ERROR_TEXT, text).withColumn(
        ERROR_FLAG, F.char_length(F.col(ERROR_TEXT)) > 0
    )


def flag_rows(
    df: DataFrame,
    spec: TableSpec,
    *,
    scratch: Scratch,
    extra_rules: Sequence[Rule] = (),
    check_types: bool = False,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The frame with its error columns: required, duplicate key, type and extra rules."""
    rules = required_rules(df, spec)
    key = [c for c in spec.key if c in df.columns]
    if key:
        df = mark_duplicates(df, key, scratch=scratch, hot_rows=hot_rows)
        rules.append(Rule(duplicate_message(key), F.col("_duplicated")))
    if check_types:
        rules += castable_rules(df, spec)
    return apply_rules(df, [*rules, *extra_rules]).drop("_duplicated")


def valid_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(~F.col(ERROR_FLAG)).drop(ERROR_FLAG, ERROR_TEXT)


def invalid_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col(ERROR_FLAG))


def split_counts(flagged: DataFrame) -> DataFrame:
    """One row: total, valid and invalid rows."""
    return flagged.agg(
        F.count("*").alias("total_rows"),
        F.count_if(~F.col(ERROR_FLAG)).alias("valid_rows"),
        F.count_if(F.col(ERROR_FLAG)).alias("invalid_rows"),
    )


def error_histogram(flagged: DataFrame) -> DataFrame:
    """Rows per single error message."""
    return (
        invalid_rows(flagged)
        .groupBy(ERROR_TEXT)
        .agg(F.count("*").alias("_rows"))
        .select(F.explode(F.split(ERROR_TEXT, SEPARATOR)).alias("message"), "_rows")
        .groupBy("message")
        .agg(F.sum("_rows").alias("row_count"))
    )


def quarantine_rows(
    invalid: DataFrame,
    *,
    run_id: str,
    stage: str,
    source_id: str,
    table_name: str,
    default_message: str = DEFAULT_ERROR,
) -> DataFrame:
    """Rejected rows as JSON with what was wrong, by run, stage, source and table."""
    data = [c for c in invalid.columns if c not in (ERROR_FLAG, ERROR_TEXT)]
    own = F.col(ERROR_TEXT) if ERROR_TEXT in invalid.columns else F.lit(None).cast("string")
    return invalid.select(
        F.lit(run_id).alias("run_id"),
        F.lit(stage).alias("stage"),
        F.lit(source_id).alias("source_id"),
        F.lit(table_name).alias("table_name"),
        row_json(invalid, data).alias("raw_row_json"),
        F.coalesce(F.nullif(own, F.lit("")), F.lit(default_message)).alias("error_message"),
        F.current_timestamp().alias("persisted_at"),
    )


def quarantined(
    rows: DataFrame, *, run_id: str | None = None, table_name: str | None = None
) -> DataFrame:
    """Quarantined rows of a run, of a table, or of both."""
    return where_equal(rows, run_id=run_id, table_name=table_name)


def reconcile(
    source: DataFrame, target: DataFrame, key: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """Keys whose row counts or summed measures differ between two tables.

    Both sides are aggregated to one row per key before they meet.
    """

    def totals(df: DataFrame, prefix: str) -> DataFrame:
        sums = [F.sum(F.col(f"`{m}`").cast("decimal(38,6)")).alias(f"{prefix}_{m}") for m in measures]
        return df.groupBy(*key).agg(F.count("*").alias(f"{prefix}_rows"), *sums)

    both = totals(source, "source").join(totals(target, "target"), list(key), "full_outer")
    differs = F.lit(False)
    for name in ["rows", *measures]:
        differs = differs | ~F.col(f"source_{name}").eqNullSafe(F.col(f"target_{name}"))
    return both.filter(differs)
