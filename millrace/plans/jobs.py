"""Whole jobs: canonical tables, derived tables, chunk indexes, and a run over all of them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.keys import with_record_hash
from millrace.operators import audit
from millrace.operators.derive import Transform, run_chain
from millrace.operators.documents import can_fail, chunk_documents, project_documents
from millrace.operators.index import index_rows
from millrace.operators.lookups import HOT_ROWS
from millrace.operators.maintain import GroupStates
from millrace.operators.merge import orphan_keys
from millrace.operators.quality import (
    ERROR_FLAG,
    ERROR_TEXT,
    Rule,
    apply_rules,
    castable_rules,
    duplicate_keys,
    duplicate_message,
    flag_rows,
    quarantine_rows,
    valid_rows,
)
from millrace.operators.shape import (
    dedupe,
    fill_missing,
    fill_required_defaults,
    relaxed_union,
    target_projection,
    where_equal,
)
from millrace.scratch import Scratch
from millrace.sources.tables import BUCKET, LoadResult, TableStore
from millrace.spec import DocumentSpec, TableSpec, gate_errors, schema_gate

log = logging.getLogger(__name__)

# The state of each index bucket when it was written.
INDEX_DIGESTS = "etl_index_digests"
DIGEST_SCHEMA = (
    "semantic_id string, _bucket int, documents long, low string, high string, folder string"
)

# What the name of a maintained table's states ends in.
STATES = "__states"

# Names of the system tables and wording of failed steps.
QUARANTINE_TABLE = "etl_dlq"
LINEAGE_TABLE = "etl_lineage"
RUN_TABLE = "etl_run_tracking"
INDEX_TABLE = "etl_semantic_index"
CHILD_ERRORS = "Pipeline completed with child errors."
NO_DOCUMENTS = "No documents projected — source table may be empty."
GATE_FAILED = "Schema validation failed: "


@dataclass(frozen=True)
class Source:
    """What feeds one canonical table.

    ``read`` gives the frames of the source: one or several, whose columns may
    differ. Each may carry ``_file_hash`` and ``_source_file``.
    """

    source_id: str
    read: Callable[[SparkSession], DataFrame | Sequence[DataFrame]]
    after_read: tuple[Transform, ...] = ()


@dataclass(frozen=True)
class CanonicalTable:
    """A table loaded from sources.

    With ``check_types``, rows with a value that the declared type cannot hold
    are rejected; without, such values become null. ``after_validation`` changes the
    valid rows; ``after_load`` gets what was loaded, its result is not used.
    """

    spec: TableSpec
    sources: tuple[Source, ...]
    before_validation: tuple[Transform, ...] = ()
    before_load: tuple[Transform, ...] = ()
    after_validation: tuple[Transform, ...] = ()
    after_load: tuple[Transform, ...] = ()
    rules: Callable[[DataFrame], Sequence[Rule]] = field(default=lambda df: ())
    check_types: bool = True


@dataclass(frozen=True)
class DerivedTable:
    """``build`` makes the table out of the tables it depends on.

    ``before_build`` is applied to each of these tables. With ``maintained`` in place of
    ``build``, the table is made of group states of the one table it depends on, which
    are kept up to date from what changed in that table.
    """

    spec: TableSpec
    build: Callable[[Mapping[str, DataFrame]], DataFrame] | None = None
    before_build: tuple[Transform, ...] = ()
    after_build: tuple[Transform, ...] = ()
    maintained: GroupStates | None = None

    def __post_init__(self) -> None:
        if (self.build is None) == (self.maintained is None):
            raise ValueError("A derived table is either built or maintained.")
        if self.maintained and len(self.spec.depends_on) != 1:
            raise ValueError("A maintained table depends on one table.")


@dataclass
class TableResult:
    table_name: str
    kind: str
    source_id: str = ""
    load: LoadResult | None = None
    valid_rows: int = 0
    invalid_rows: int = 0
    held_rows: int = 0
    issues: list = field(default_factory=list)
    error: str | None = None


@dataclass
class IndexResult:
    semantic_id: str
    source_table: str
    documents: int = 0
    failed_rows: int = 0
    chunks: int = 0
    error: str | None = None


@dataclass
class RunResult:
    run_id: str
    tables: list[TableResult] = field(default_factory=list)
    indexes: list[IndexResult] = field(default_factory=list)
    error: str | None = None

    @property
    def rows_loaded(self) -> int:
        """Rows inserted or updated in canonical tables; derived rows are not counted."""
        return sum(r.load.total_affected for r in self.tables if r.load and r.kind == "canonical")

    @property
    def rows_invalid(self) -> int:
        return sum(r.invalid_rows for r in self.tables if r.kind == "canonical")

    @property
    def chunks_indexed(self) -> int:
        return sum(r.chunks for r in self.indexes)


def batch_of(spark: SparkSession, table: CanonicalTable, applied: list[str]) -> DataFrame | None:
    """Union of all sources of the table, hashed as read and then transformed.

    The record hash covers the raw values: it is taken before the transforms.
    """
    frames = []
    for source in table.sources:
        read = source.read(spark)
        for frame in [read] if isinstance(read, DataFrame) else read:
            frame = run_chain(frame, source.after_read, applied=applied)
            absent = {c: F.lit("unknown") for c in table.spec.system_columns[:2] if c not in frame.columns}
            frames.append(frame.withColumns(absent) if absent else frame)
    batch = relaxed_union(frames)
    if batch is None:
        return None
    if table.spec.record_hash:
        batch = with_record_hash(batch, table.spec.declared_names)
    return run_chain(batch, table.before_validation, applied=applied)


def load_canonical(
    store: TableStore,
    table: CanonicalTable,
    *,
    run_id: str,
    scratch: Scratch,
    lineage: audit.LineageLog,
    hot_rows: int = HOT_ROWS,
    quarantine_table: str = QUARANTINE_TABLE,
) -> TableResult:
    """Read, shape, check, quarantine and load one canonical table.

    A batch without the columns the table needs is held whole: nothing of it is loaded
    or quarantined, and its rows are counted as held.
    """
    spec = table.spec
    source_id = _source_ids(table)
    result = TableResult(spec.name, spec.kind, source_id)
    applied: list[str] = []
    batch = batch_of(store.spark, table, applied)
    if batch is not None:
        batch = run_chain(batch, table.before_load, applied=applied)
    result.issues = schema_gate(batch, spec)
    errors = gate_errors(result.issues)
    if errors:
        result.error = GATE_FAILED + "; ".join(i.reason for i in errors)
        result.held_rows = 0 if batch is None else batch.count()
        return result

    batch = fill_required_defaults(fill_missing(batch, spec), spec)
    if spec.dedupe_before_load:
        batch = dedupe(batch, spec.declared_names)
    flagged = flag_rows(
        batch,
        spec,
        scratch=scratch,
        extra_rules=table.rules(batch),
        check_types=table.check_types,
        hot_rows=hot_rows,
    )
    # Written once, split by the flag: the two sides are then read separately.
    staged = scratch.stage(flagged, f"checked-{spec.name}", partition_by=[ERROR_FLAG])
    invalid = staged.filter(F.col(ERROR_FLAG))
    result.invalid_rows = invalid.count()
    if result.invalid_rows:
        rejected = quarantine_rows(
            invalid, run_id=run_id, stage="validation", source_id=source_id, table_name=spec.name
        )
        store.append_rows(quarantine_table, rejected, "table_name")
    checked = run_chain(valid_rows(staged), table.after_validation, applied=applied)
    valid = target_projection(checked, spec)
    # The duplicate rule has seen to the keys, unless a transform came after it.
    result.load = store.write(spec, valid, unique_keys=not table.after_validation)
    run_chain(valid, table.after_load, applied=applied)
    result.valid_rows = result.load.inserted_rows + result.load.updated_rows

    lineage.files_of(staged, spec.name)
    for name in applied:
        lineage.hook(name, "transform", spec.name)
    lineage.output(spec.name, spec.name)
    return result


def maintained_states(store: TableStore, table: DerivedTable) -> DataFrame:
    """Group states of the table's source, brought up to its present version.

    Folders that came or went since the version of the stored states are all that is
    read; where that is impossible or no less than the whole, states are made anew. A
    run that was lost before it noted the version is made up for in the same way.
    """
    (source,) = table.spec.depends_on
    name = f"{table.spec.name}{STATES}"
    version = store.version(source)
    stored = store.read(name) if store.exists(name) else None
    since = stored.agg(F.max("_version")).first()[0] if stored is not None else None
    if stored is not None and since == version:
        return stored.drop("_version")
    changes = store.changes(source, since) if since else None
    if changes is None:
        rows = run_chain(store.read(source), table.before_build)
        states = table.maintained.states(rows)
    else:
        states = table.maintained.merged(
            stored.drop("_version"),
            table.maintained.states(run_chain(changes, table.before_build), sign="_sign"),
        )
    # States and version are one commit: neither is ever seen without the other.
    store.rewrite(name, states.withColumn("_version", F.lit(version)))
    return store.read(name).drop("_version")


def load_derived(
    store: TableStore, table: DerivedTable, *, scratch: Scratch, lineage: audit.LineageLog
) -> TableResult:
    """Build and load one derived table.

    A key that comes out twice is an error, and so is a value that the declared
    type cannot hold: a build has no quarantine.
    """
    spec = table.spec
    result = TableResult(spec.name, spec.kind)
    if table.maintained:
        built = table.maintained.finish(maintained_states(store, table))
    else:
        inputs = {n: run_chain(store.read(n), table.before_build) for n in spec.depends_on}
        built = table.build(inputs)
    if built is None:
        result.error = f"Build of derived table '{spec.name}' gave no frame."
        return result
    built = run_chain(built, table.after_build)
    if spec.record_hash:
        built = with_record_hash(built, spec.declared_names, length=32)
    checked = apply_rules(built, castable_rules(built, spec))
    staged = scratch.stage(checked, f"built-{spec.name}")
    misfit = staged.filter(F.col(ERROR_FLAG)).first()
    if misfit:
        result.error = misfit[ERROR_TEXT]
        return result
    rows = target_projection(valid_rows(staged), spec)
    if spec.key and not duplicate_keys(rows, spec.key).isEmpty():
        result.error = duplicate_message(spec.key)
        return result
    result.load = store.write(spec, rows, unique_keys=True)
    result.valid_rows = result.load.total_affected
    lineage.output(spec.name, spec.name, "derive")
    return result


def load_index(
    store: TableStore,
    spec: DocumentSpec,
    *,
    run_id: str,
    scratch: Scratch,
    lineage: audit.LineageLog,
    unique_rows: bool = True,
    allow_empty: bool = False,
) -> IndexResult:
    """Project, chunk and index the rows of one table.

    Rows become chunks in one pass that ends in the write: nothing is shuffled.
    The new chunks become the whole content of the semantic id's partition; with
    ``index_buckets`` only buckets with changed documents are chunked and written.
    Nothing projected is an error that leaves the stored chunks alone, unless
    ``allow_empty``. Set ``unique_rows`` to False for a table without a key,
    whose equal rows would give equal documents.
    """
    result = IndexResult(spec.semantic_id, spec.source_table)
    rows = store.read(spec.source_table)
    documents, failures = project_documents(rows, spec, scratch=scratch)
    if can_fail(spec):
        result.failed_rows = failures.count()
    if not unique_rows and spec.id_strategy == "deterministic_hash":
        documents = documents.distinct()
    if spec.index_buckets:
        written = _index_changed(store, spec, documents, run_id)
    else:
        chunks = chunk_documents(documents, size=spec.chunk_size, overlap=spec.chunk_overlap)
        written = store.replace_partition(
            INDEX_TABLE, index_rows(chunks, run_id), "semantic_id", spec.semantic_id
        )
    if not written:
        if allow_empty and result.failed_rows == 0:
            store.drop_partition(INDEX_TABLE, spec.semantic_id)
        else:
            result.error = NO_DOCUMENTS
        return result
    indexed = where_equal(store.read(INDEX_TABLE), semantic_id=spec.semantic_id)
    firsts = F.count_if(F.col("chunk_index") == 0)
    result.chunks, result.documents = indexed.agg(F.count("*"), firsts).first()
    lineage.output(spec.source_table, f"semantic::{spec.semantic_id}", "semantic")
    return result


def _index_changed(
    store: TableStore, spec: DocumentSpec, documents: DataFrame, run_id: str
) -> bool:
    """Write the index buckets whose documents changed; says whether there are documents.

    A document belongs to the bucket of its source key. Sums of hashes over the documents
    of a bucket tell whether it is as it was when its folder was written; such buckets
    are neither chunked nor written, and their chunks keep the run that wrote them. The
    digests are stored after the index: where a run is lost in between, or a folder is
    no longer live, its bucket is written again.
    """
    bucket = F.pmod(F.xxhash64(F.coalesce("source_pk", "doc_id")), F.lit(spec.index_buckets))
    bucketed = documents.withColumn(BUCKET, bucket.cast("int"))
    content = [F.col(c) for c in ("doc_id", "source_pk", "title", "body", "metadata", "tags")]
    shape = [F.lit(spec.chunk_size), F.lit(spec.chunk_overlap), F.lit(spec.index_buckets)]
    sums = [
        F.sum(F.xxhash64(F.lit(seed), *shape, *content).cast("decimal(38,0)")).cast("string").alias(name)
        for seed, name in ((1, "low"), (2, "high"))
    ]
    digests = bucketed.groupBy(BUCKET).agg(F.count("*").alias("documents"), *sums).collect()
    if not digests:
        return False
    live = set(store.partition_folders(INDEX_TABLE, spec.semantic_id))
    known = {}
    if store.exists(INDEX_DIGESTS):
        stored = where_equal(store.read(INDEX_DIGESTS), semantic_id=spec.semantic_id)
        known = {r[BUCKET]: r for r in stored.collect() if r["folder"] in live}
    same = {
        r[BUCKET]: known[r[BUCKET]]["folder"]
        for r in digests
        if r[BUCKET] in known and all(known[r[BUCKET]][c] == r[c] for c in ("documents", "low", "high"))
    }
    gone = live - set(same.values())
    changed = [r[BUCKET] for r in digests if r[BUCKET] not in same]
    if not changed and not gone:
        return True
    if same:
        bucketed = bucketed.filter(F.col(BUCKET).isin(changed))
    chunks = chunk_documents(bucketed, size=spec.chunk_size, overlap=spec.chunk_overlap)
    bucket = F.pmod(F.xxhash64(F.coalesce("source_pk", "doc_id")), F.lit(spec.index_buckets))
    rows = index_rows(chunks, run_id).withColumn(BUCKET, bucket.cast("int"))
    folders = same | store.replace_buckets(INDEX_TABLE, rows, "semantic_id", gone)
    noted = [
        (spec.semantic_id, r[BUCKET], r["documents"], r["low"], r["high"], folders[r[BUCKET]])
        for r in digests
    ]
    frame = store.spark.createDataFrame(noted, DIGEST_SCHEMA)
    return store.replace_partition(INDEX_DIGESTS, frame, "semantic_id", spec.semantic_id)


def _source_ids(table: CanonicalTable) -> str:
    return ",".join(s.source_id for s in table.sources)


def _by_source(tables: Sequence[CanonicalTable]) -> list[CanonicalTable]:
    """Each source of a table as a load of its own, in order, so that a later source
    updates an earlier one and a bad one fails alone. What replaces a table is united."""
    loads = []
    for table in tables:
        alone = table.spec.load_mode != "replace" and len(table.sources) > 1
        parts = [(s,) for s in table.sources] if alone else [table.sources]
        loads += [replace(table, sources=part) for part in parts]
    return loads


def build_order(tables: Sequence[DerivedTable]) -> list[DerivedTable]:
    """Derived tables after the derived tables they depend on."""
    by_name = {t.spec.name: t for t in tables}
    graph = {n: [d for d in t.spec.depends_on if d in by_name] for n, t in by_name.items()}
    return [by_name[n] for n in TopologicalSorter(graph).static_order()]


def run_project(
    store: TableStore,
    *,
    project_id: str,
    canonical: Sequence[CanonicalTable] = (),
    derived: Sequence[DerivedTable] = (),
    documents: Sequence[DocumentSpec] = (),
    run_id: str | None = None,
    scratch: Scratch | None = None,
    quarantine_table: str = QUARANTINE_TABLE,
) -> RunResult:
    """Load canonical tables, build derived ones, index documents, record the run.

    A table or index that fails is noted and the others go on; the run then
    counts as failed.
    """
    spark = store.spark
    own_scratch = scratch is None
    scratch = scratch or Scratch(spark)
    run_id = run_id or audit.new_run_id()
    result = RunResult(run_id)
    lineage = audit.LineageLog(run_id)
    store.append_rows(RUN_TABLE, audit.run_event(spark, run_id, project_id, "started"))

    try:
        for table in _by_source(canonical):
            name = table.spec.name
            result.tables.append(
                _guarded(
                    lambda table=table: load_canonical(
                        store,
                        table,
                        run_id=run_id,
                        scratch=scratch,
                        lineage=lineage,
                        quarantine_table=quarantine_table,
                    ),
                    lambda error, table=table: TableResult(
                        table.spec.name, "canonical", _source_ids(table), error=error
                    ),
                )
            )
        try:
            ordered = build_order(derived)
        except CycleError as problem:
            ordered = []
            circle = f"Derived tables depend on each other: {problem.args[1]}"
            result.tables += [TableResult(t.spec.name, "derived", error=circle) for t in derived]
        for table in ordered:
            name = table.spec.name
            result.tables.append(
                _guarded(
                    lambda table=table: load_derived(store, table, scratch=scratch, lineage=lineage),
                    lambda error, name=name: TableResult(name, "derived", error=error),
                )
            )
        for spec in documents:
            result.indexes.append(
                _guarded(
                    lambda spec=spec: load_index(
                        store, spec, run_id=run_id, scratch=scratch, lineage=lineage
                    ),
                    lambda error, spec=spec: IndexResult(
                        spec.semantic_id, spec.source_table, error=error
                    ),
                )
            )

        if any(r.error for r in [*result.tables, *result.indexes]):
            result.error = CHILD_ERRORS
        if lineage.rows or lineage.frames:
            store.append_rows(LINEAGE_TABLE, lineage.frame(spark))
        ended = audit.run_event(
            spark,
            run_id,
            project_id,
            "failed" if result.error else "completed",
            sources=len({s.source_id for t in canonical for s in t.sources}),
            tables=len({r.table_name for r in result.tables}),
            loaded=result.rows_loaded,
            invalid=result.rows_invalid,
            error=result.error,
        )
        store.append_rows(RUN_TABLE, ended)
    finally:
        if own_scratch:
            scratch.clear()
    return result


def _guarded(work: Callable, failed: Callable[[str], object]):
    try:
        return work()
    except Exception as problem:
        log.exception("A step of the run failed")
        return failed(f"{type(problem).__name__}: {problem}")


def load_results(spark: SparkSession, result: RunResult) -> DataFrame:
    """Loads of a run as rows, one per table."""
    rows = [
        (
            result.run_id,
            r.source_id,
            r.table_name,
            r.kind,
            r.load.mode if r.load else None,
            r.load.inserted_rows if r.load else 0,
            r.load.updated_rows if r.load else 0,
            r.load.total_affected if r.load else 0,
            r.invalid_rows,
            r.error,
        )
        for r in result.tables
    ]
    return spark.createDataFrame(rows, audit.LOAD_SCHEMA)


def foreign_key_report(store: TableStore, spec: TableSpec) -> DataFrame | None:
    """Keys without a parent for each declared foreign key, with their row counts.

    Foreign keys are not enforced at load. None when the table declares none.
    """
    child = store.read(spec.name)
    reports = []
    for fk in spec.foreign_keys:
        parent = store.read(fk.target_table)
        orphans = orphan_keys(child, parent, fk.columns, fk.target_columns)
        reports.append(
            orphans.select(
                F.lit(spec.name).alias("table_name"),
                F.lit(fk.target_table).alias("target_table"),
                F.to_json(F.struct(*fk.columns)).alias("key"),
                "child_rows",
            )
        )
    return relaxed_union(reports)


def apply_retention(store: TableStore, days: int = 90) -> None:
    """Drop run records and lineage events older than the retention period."""
    for name, at in ((RUN_TABLE, "at"), (LINEAGE_TABLE, "recorded_at")):
        if store.exists(name):
            store.rewrite(name, audit.younger_than(store.read(name), at, days))
