"""Row templates such as ``"{name} is in {city}"`` compiled to Spark expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from string import Formatter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import column_display

PLAIN_NAME = re.compile(r"[^.\[\]!:{}]+")


@dataclass(frozen=True)
class TemplatePart:
    """A run of literal text followed, unless it is the last one, by a field."""

    literal: str
    field: str | None


def plain_parts(template: str) -> list[TemplatePart] | None:
    """Parts of a template with bare field names only, or None when it needs more."""
    parts = []
    for literal, field, spec, conversion in Formatter().parse(template):
        if field is not None:
            bare = PLAIN_NAME.fullmatch(field) and not field.isdigit()
            if spec or conversion or not bare:
                return None
        parts.append(TemplatePart(literal, field))
    return parts


def render(df: DataFrame, template: str, *, null_text: str = "None") -> tuple[Column, Column]:
    """Columns holding the rendered text and the reason of a failed row (null when fine).

    A field the frame lacks gives empty text; a null value gives ``null_text``.
    Templates with bare fields stay inside Spark's own expressions and cannot
    fail. Format specs, conversions and attribute access run as an Arrow UDF.
    """
    parts = plain_parts(template)
    if parts is None:
        both = _formatted(df, template)
        return both["text"], both["error"]
    pieces: list[Column] = []
    for part in parts:
        if part.literal:
            pieces.append(F.lit(part.literal))
        if part.field is not None and part.field in df.columns:
            pieces.append(F.coalesce(column_display(df, part.field), F.lit(null_text)))
    text = F.concat(*pieces) if pieces else F.lit("")
    return text, F.lit(None).cast("string")


class _Row(dict):
    """A row whose unknown names read as empty text."""

    def __missing__(self, key: str) -> str:
        return ""


def _formatted(df: DataFrame, template: str) -> Column:
    named = {
        re.split(r"[.\[]", field)[0]
        for _, field, _, _ in Formatter().parse(template)
        if field is not None
    }
    used = [c for c in df.columns if c in named]

    @F.arrow_udf("text string, error string")
    def fill(rows: pa.Array) -> pa.Array:
        out = []
        for row in rows.to_pylist():
            try:
                out.append({"text": template.format_map(_Row(row)), "error": None})
            except Exception as problem:  # a row that cannot be rendered is reported, not fatal
                out.append({"text": None, "error": str(problem)})
        return pa.array(out, pa.struct([("text", pa.string()), ("error", pa.string())]))

    fields = [F.col(f"`{c}`").alias(c) for c in used] or [F.lit(1).alias("_")]
    return fill(F.struct(*fields))
