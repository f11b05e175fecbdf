"""Rows to documents, documents to overlapping chunks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.template import plain_parts, render
from millrace.functions.text import column_display, json_field, row_json
from millrace.scratch import Scratch
from millrace.spec import DocumentSpec, check_chunk_bounds

DOCUMENT_COLUMNS = (
    "doc_id",
    "source_table",
    "source_pk",
    "semantic_id",
    "title",
    "body",
    "metadata",
    "tags",
    "source_row_index",
)


def metadata_json(df: DataFrame, fields: Sequence[str], extra: Mapping[str, Any]) -> Column:
    """JSON object of the chosen fields (null where absent), overridden by the extra values."""
    values: dict[str, Column] = {}
    for name in fields:
        values[name] = json_field(df, name) if name in df.columns else F.lit(None).cast("string")
    for name, value in extra.items():
        values[name] = _literal(value)
    if not values:
        return F.lit("{}")
    return F.to_json(
        F.struct(*[c.alias(n) for n, c in values.items()]), {"ignoreNullFields": "false"}
    )


def _literal(value: Any) -> Column:
    if value is None:
        return F.lit(None).cast("string")
    if isinstance(value, (dict, list, tuple)):
        text = json.dumps(value, default=str)
        return F.parse_json(F.lit(text))
    return F.lit(value)


def tags_array(df: DataFrame, fields: Sequence[str]) -> Column:
    """Texts of the non-null tag fields, in order."""
    texts = [column_display(df, f) for f in fields if f in df.columns]
    return F.array_compact(F.array(*texts)) if texts else F.array().cast("array<string>")


def content_id(df: DataFrame, semantic_id: str, columns: Sequence[str] = ()) -> Column:
    """32 hex characters over the row's columns, sorted by name; all columns unless given.

    Covering all columns includes the hash of the source file, so any change of
    that file renames all its documents. Key plus ``_record_hash`` avoids that.
    """
    row = row_json(df, sorted(columns or df.columns))
    return F.substring(F.sha2(F.concat(F.lit(f"{semantic_id}::"), row), 256), 1, 32)


def with_row_index(
    df: DataFrame, order_by: Sequence[str], *, scratch: Scratch, target: str = "_row_index"
) -> DataFrame:
    """Number the rows 0, 1, 2, … in the given order, in parallel.

    Rows are range-partitioned and sorted; a row's number is its place in its
    partition plus the rows in the partitions before. Rows with equal order
    columns go by a hash of all columns, and equal rows by their place in the
    input, so that a run of them can be divided between tasks. ``df`` should be
    read from files or staged: then a repeated task sees the same places.
    """
    if not order_by:
        raise ValueError("Row numbers need order columns.")
    content = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    order = [F.col(f"`{c}`") for c in [*order_by, "_content", "_input_place"]]
    sorted_rows = (
        df.withColumns({"_content": content, "_input_place": F.monotonically_increasing_id()})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .drop("_content", "_input_place")
        .withColumn("_place", F.monotonically_increasing_id())
    )
    staged = scratch.stage(sorted_rows, "sorted")
    # The upper bits of the generated id are the partition, the lower 33 the row in it.
    part = F.shiftrightunsigned("_place", 33)
    numbered = staged.withColumn("_part", part).withColumn(
        "_in_part", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = [
        (r["_part"], r["_rows"])
        for r in numbered.groupBy("_part").agg(F.count("*").alias("_rows")).collect()
    ]  # one row per sorted partition
    offsets, seen = [], 0
    for number, rows in sorted(sizes):
        offsets.append((number, seen))
        seen += rows
    offset_table = df.sparkSession.createDataFrame(offsets, "_part bigint, _offset bigint")
    return (
        numbered.join(F.broadcast(offset_table), "_part")
        .withColumn(target, F.col("_offset") + F.col("_in_part"))
        .drop("_part", "_in_part", "_place", "_offset")
    )


ID_STRATEGIES = ("deterministic_hash", "row_index")


def can_fail(spec: DocumentSpec) -> bool:
    """Whether rows can fail at all: templates of bare fields render any row."""
    templates = [t for t in (spec.title_template, spec.body_template) if t]
    return spec.id_strategy not in ID_STRATEGIES or any(plain_parts(t) is None for t in templates)


def project_documents(
    df: DataFrame, spec: DocumentSpec, *, scratch: Scratch | None = None
) -> tuple[DataFrame, DataFrame]:
    """Documents of the rows, and the rows that failed with the reason.

    ``source_row_index`` is filled for the row_index id strategy only: numbering
    rows takes a sort, which content ids do not need.
    """
    columns = df.columns
    if spec.id_strategy == "row_index":
        df = with_row_index(df, spec.order_by, scratch=scratch or Scratch(df.sparkSession))
        index = F.col("_row_index")
        doc_id = F.concat(F.lit(f"{spec.semantic_id}_"), index.cast("string"))
        strategy_error = F.lit(None).cast("string")
    elif spec.id_strategy == "deterministic_hash":
        index = F.lit(None).cast("bigint")
        doc_id = content_id(df, spec.semantic_id, spec.id_columns)
        strategy_error = F.lit(None).cast("string")
    else:
        index = F.lit(None).cast("bigint")
        doc_id = F.lit(None).cast("string")
        strategy_error = F.lit(f"Unsupported document_id_strategy: {spec.id_strategy}")

    source = df.select(*columns)
    body, body_error = render(source, spec.body_template)
    if spec.title_template:
        title, title_error = render(source, spec.title_template)
    else:
        title, title_error = F.lit(None).cast("string"), F.lit(None).cast("string")
    if spec.source_pk and spec.source_pk in columns:
        source_pk = column_display(df, spec.source_pk)
    else:
        source_pk = F.lit(None).cast("string")

    projected = df.select(
        doc_id.alias("doc_id"),
        F.lit(spec.source_table).alias("source_table"),
        source_pk.alias("source_pk"),
        F.lit(spec.semantic_id).alias("semantic_id"),
        title.alias("title"),
        body.alias("body"),
        metadata_json(source, spec.metadata_fields, spec.extra_metadata).alias("metadata"),
        tags_array(source, spec.tag_fields).alias("tags"),
        index.alias("source_row_index"),
        F.coalesce(title_error, body_error, strategy_error).alias("reason"),
        row_json(source, columns).alias("raw_row_json"),
    )
    if can_fail(spec):
        # Written once: both sides of the split would else render every row again.
        projected = (scratch or Scratch(df.sparkSession)).stage(projected, "projected")
    documents = projected.filter(F.col("reason").isNull()).select(*DOCUMENT_COLUMNS)
    failures = projected.filter(F.col("reason").isNotNull()).select("raw_row_json", "reason")
    return documents, failures


def chunk_texts(body: Column, size: int, overlap: int) -> Column:
    """Array of windows of ``size`` characters, one every ``size - overlap`` characters.

    A looked-ahead group takes the window while the match itself moves on by one
    step, so the text is read once from front to back. Cutting by position would
    count characters from the start of the text for every window.
    """
    check_chunk_bounds(size, overlap)
    pattern = f"(?s)(?=(.{{1,{size}}})).{{1,{size - overlap}}}"
    text = F.coalesce(body, F.lit(""))
    windows = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(text == "", F.array(F.lit(""))).otherwise(windows)


def chunk_documents(documents: DataFrame, *, size: int = 1000, overlap: int = 100) -> DataFrame:
    """One row per chunk of every document; an empty body gives one empty chunk."""
    return documents.select(
        "doc_id",
        "semantic_id",
        "source_table",
        "source_pk",
        "title",
        "metadata",
        "tags",
        F.posexplode(chunk_texts(F.col("body"), size, overlap)).alias("chunk_index", "chunk_text"),
    ).select(
        F.concat_ws("_", "doc_id", "chunk_index").alias("chunk_id"),
        "doc_id",
        "semantic_id",
        "source_table",
        "source_pk",
        "chunk_index",
        "chunk_text",
        "title",
        "metadata",
        "tags",
        F.char_length("chunk_text").alias("char_count"),
    )


def chunk_totals(documents: DataFrame, chunks: DataFrame, by: str = "semantic_id") -> DataFrame:
    """Documents, chunks and chunk characters per semantic id."""
    counted = documents.groupBy(by).agg(F.count("*").alias("total_documents"))
    produced = chunks.groupBy(by).agg(
        F.count("*").alias("total_chunks"), F.sum("char_count").alias("total_chars")
    )
    return counted.join(produced, by, "left")
