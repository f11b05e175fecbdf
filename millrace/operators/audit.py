"""Lineage events, run records and totals."""

from __future__ import annotations

from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.shape import where_equal

LINEAGE_SCHEMA = (
    "run_id string, seq bigint, event_type string, source_ref string, target_ref string, "
    "stage string, hook_name string, table_name string, recorded_at timestamp"
)
RUN_SCHEMA = (
    "run_id string, project_id string, status string, at timestamp, source_count bigint, "
    "table_count bigint, total_rows_loaded bigint, total_rows_invalid bigint, "
    "error_message string"
)
LOAD_SCHEMA = (
    "run_id string, source_id string, table_name string, table_kind string, mode string, "
    "inserted_rows bigint, updated_rows bigint, total_affected bigint, invalid_rows bigint, "
    "error string"
)


def now_utc() -> datetime:
    return datetime.now(timezone.utc)


def new_run_id() -> str:
    return str(uuid4())


class LineageLog:
    """Events of one run in the order they happened, written together as rows."""

    def __init__(self, run_id: str) -> None:
        self.run_id = run_id
        self.rows: list[tuple] = []
        self.frames: list[DataFrame] = []

    def _next(self) -> int:
        return len(self.rows) + len(self.frames)

    def _add(self, kind: str, source: str, target: str, stage: str, hook: str | None, table: str):
        row = (self.run_id, self._next(), kind, source, target, stage, hook, table, now_utc())
        self.rows.append(row)

    def file(self, source_path: str, table: str, stage: str = "read") -> None:
        self._add("file", source_path, table, stage, None, table)

    def files_of(self, batch: DataFrame, table: str) -> None:
        """File events of a batch, left to Spark: a batch may come from very many files."""
        self.frames.append(file_events(batch, self.run_id, table, seq=self._next(), at=now_utc()))

    def hook(self, name: str, stage: str, table: str, source_ref: str = "") -> None:
        self._add("hook", source_ref or table, table, stage, name, table)

    def stage(self, stage: str, table: str, source_ref: str = "") -> None:
        self._add("stage", source_ref or table, table, stage, None, table)

    def output(self, table: str, output_ref: str, stage: str = "load") -> None:
        self._add("output", table, output_ref, stage, None, table)

    def frame(self, spark: SparkSession) -> DataFrame:
        events = spark.createDataFrame(self.rows, LINEAGE_SCHEMA)
        for more in self.frames:
            events = events.unionByName(more)
        return events


def file_events(
    batch: DataFrame,
    run_id: str,
    table: str,
    *,
    stage: str = "read",
    seq: int = 0,
    at: datetime | None = None,
) -> DataFrame:
    """One file event per source file of a batch, taken from its provenance column."""
    return (
        batch.select("_source_file")
        .distinct()
        .select(
            F.lit(run_id).alias("run_id"),
            F.lit(seq).cast("bigint").alias("seq"),
            F.lit("file").alias("event_type"),
            F.col("_source_file").alias("source_ref"),
            F.lit(table).alias("target_ref"),
            F.lit(stage).alias("stage"),
            F.lit(None).cast("string").alias("hook_name"),
            F.lit(table).alias("table_name"),
            F.lit(at or now_utc()).cast("timestamp").alias("recorded_at"),
        )
    )


def lineage_of(
    events: DataFrame, *, run_id: str | None = None, table_name: str | None = None
) -> DataFrame:
    """Events of a run or a table, in the order they were recorded."""
    found = where_equal(events, run_id=run_id, table_name=table_name)
    return found.orderBy("recorded_at", "run_id", "seq", "source_ref")


def run_event(
    spark: SparkSession,
    run_id: str,
    project_id: str,
    status: str,
    *,
    sources: int = 0,
    tables: int = 0,
    loaded: int = 0,
    invalid: int = 0,
    error: str | None = None,
) -> DataFrame:
    """One row for the start, completion or failure of a run."""
    if status not in ("started", "completed", "failed"):
        raise ValueError(f"Unknown run status '{status}'.")
    row = (run_id, project_id, status, now_utc(), sources, tables, loaded, invalid, error)
    return spark.createDataFrame([row], RUN_SCHEMA)


def run_records(events: DataFrame) -> DataFrame:
    """Current state of each run: its first start, and its latest end if it has one."""
    started = F.col("status") == "started"
    last = F.max_by(
        F.struct(
            "status",
            "at",
            "source_count",
            "table_count",
            "total_rows_loaded",
            "total_rows_invalid",
            "error_message",
        ),
        F.when(~started, F.col("at")),
    )
    grouped = events.groupBy("run_id").agg(
        F.min_by("project_id", "at").alias("project_id"),
        F.min(F.when(started, F.col("at"))).alias("started_at"),
        last.alias("end"),
    )
    ended, began = F.col("end.at").cast("timestamp"), F.col("started_at").cast("timestamp")
    seconds = (F.unix_micros(ended) - F.unix_micros(began)) / 1e6
    return grouped.select(
        "run_id",
        "project_id",
        F.coalesce("end.status", F.lit("started")).alias("status"),
        "started_at",
        F.col("end.at").alias("completed_at"),
        seconds.alias("duration_seconds"),
        F.coalesce("end.source_count", F.lit(0)).alias("source_count"),
        F.coalesce("end.table_count", F.lit(0)).alias("table_count"),
        F.coalesce("end.total_rows_loaded", F.lit(0)).alias("total_rows_loaded"),
        F.coalesce("end.total_rows_invalid", F.lit(0)).alias("total_rows_invalid"),
        F.col("end.error_message").alias("error_message"),
    )


def get_run(records: DataFrame, run_id: str) -> DataFrame:
    return records.filter(F.col("run_id") == run_id)


def recent_runs(records: DataFrame, limit: int = 50) -> DataFrame:
    """Newest runs first."""
    if limit < 0:
        raise ValueError(f"Limit cannot be negative: {limit}")
    return records.orderBy(F.desc("started_at"), "run_id").limit(limit)


def run_totals(loads: DataFrame) -> DataFrame:
    """Rows loaded into canonical tables and rows rejected, per run."""
    loaded = F.when(
        F.col("table_kind") == "canonical", F.col("inserted_rows") + F.col("updated_rows")
    )
    return loads.groupBy("run_id").agg(
        F.coalesce(F.sum(loaded), F.lit(0)).alias("total_rows_loaded"),
        F.coalesce(F.sum("invalid_rows"), F.lit(0)).alias("total_rows_invalid"),
        F.count("*").alias("table_count"),
        F.count("error").alias("failed_tables"),
    )


def younger_than(rows: DataFrame, at: str, days: int, *, now: datetime | None = None) -> DataFrame:
    """Rows no older than the retention period."""
    end = F.lit(now.isoformat(" ")) if now else F.current_timestamp()
    end = end.cast(rows.schema[at].dataType)
    return rows.filter(F.col(at) >= end - F.make_dt_interval(F.lit(days)))
