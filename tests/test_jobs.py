import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import audit
from millrace.operators.derive import Transform, group_stats, group_sums, share_of_total
from millrace.operators.quality import non_negative
from millrace.operators.shape import clean
from millrace.plans.inputs import file_source, sqlite_source
from millrace.plans.jobs import (
    CHILD_ERRORS,
    CanonicalTable,
    DerivedTable,
    Source,
    apply_retention,
    build_order,
    foreign_key_report,
    load_index,
    load_results,
    run_project,
)
from millrace.sources.files import select_latest
from millrace.spec import Column, DocumentSpec, ForeignKey, TableSpec

COMPANIES = TableSpec(
    "companies",
    (
        Column("id", key=True),
        Column("name"),
        Column("year_founded", "int"),
        Column("industry", indexed=True),
        Column("country"),
        Column("current_employees", "int"),
    ),
    load_mode="upsert",
    record_hash=True,
    buckets=4,
)
INDUSTRIES = TableSpec(
    "industry_stats",
    (
        Column("industry", key=True),
        Column("company_count", "int"),
        Column("total_employees", "int"),
        Column("avg_year_founded", "int"),
    ),
    kind="derived",
    depends_on=("companies",),
    load_mode="replace",
    record_hash=True,
)
SUMMARY = TableSpec(
    "country_industry_summary",
    (
        Column("country", key=True),
        Column("industry", key=True),
        Column("country_employees", "int"),
        Column("global_industry_employees", "int"),
        Column("percent_of_global", "float"),
    ),
    kind="derived",
    depends_on=("companies", "industry_stats"),
    foreign_keys=(ForeignKey(("industry",), "industry_stats", ("industry",)),),
    load_mode="replace",
    record_hash=True,
)
DOCUMENTS = (
    DocumentSpec(
        "company_semantics",
        "companies",
        "{name} is a company in the {industry} sector, founded in {year_founded}.",
        title_template="Company: {name}",
        source_pk="id",
        metadata_fields=("id", "industry", "country"),
        tag_fields=("industry",),
        chunk_size=500,
        chunk_overlap=50,
    ),
    DocumentSpec(
        "industry_semantics",
        "industry_stats",
        "The {industry} sector consists of {company_count} companies.",
        source_pk="industry",
        chunk_size=500,
        chunk_overlap=50,
    ),
)
LAYOUT = "id string, name string, year_founded string, industry string, country string, current_employees string"
FIRST = [
    (str(i), f"c{i}", f"{1990 + i % 9}" if i % 4 else "1990.0", f"i{i % 5}" if i % 7 else None, f"x{i % 3}", str(i))
    for i in range(1, 41)
]


def clean_companies(df):
    return clean(
        df,
        casts={"year_founded": ("int", 1900), "current_employees": ("int", 0)},
        uppers={"industry": "Unknown"},
    )


def industry_stats(frames):
    return group_stats(
        frames["companies"],
        "industry",
        count="company_count",
        total=("current_employees", "total_employees"),
        mean=("year_founded", "avg_year_founded"),
    )


def summary(frames):
    parts = group_sums(
        frames["companies"], ["country", "industry"], country_employees="current_employees"
    )
    return share_of_total(
        parts,
        frames["industry_stats"],
        "industry",
        part="country_employees",
        whole="total_employees",
        whole_as="global_industry_employees",
        share="percent_of_global",
    )


def run(store, data, run_id, **more):
    frame = store.spark.createDataFrame(data, LAYOUT)
    settings = {
        "project_id": "p",
        "canonical": [
            CanonicalTable(
                COMPANIES,
                (Source("backups", lambda spark: frame),),
                before_validation=(Transform(clean_companies, order=10),),
            )
        ],
        "derived": [DerivedTable(SUMMARY, summary), DerivedTable(INDUSTRIES, industry_stats)],
        "documents": DOCUMENTS,
        "run_id": run_id,
    }
    return run_project(store, **{**settings, **more})


def index_counts(store):
    counted = store.read("etl_semantic_index").groupBy("source_table").count().collect()
    return {r["source_table"]: r["count"] for r in counted}


def test_load_repeat_modify(store, rows):
    first = run(store, FIRST, "r1")
    assert first.error is None
    assert (first.rows_loaded, first.rows_invalid, first.chunks_indexed) == (40, 0, 46)
    assert store.read("companies").count() == 40
    assert index_counts(store) == {"companies": 40, "industry_stats": 6}
    industries = rows(store.read("industry_stats"))

    second = run(store, FIRST, "r2")
    assert second.error is None
    assert (second.tables[0].load.inserted_rows, second.tables[0].load.updated_rows) == (0, 40)
    assert store.read("companies").count() == 40
    assert index_counts(store) == {"companies": 40, "industry_stats": 6}
    assert rows(store.read("industry_stats")) == industries

    changed = [(*r[:5], "9999") if r[0] == "15" else r for r in FIRST]
    changed.append(("999999", "Test Corp", "2026.0", "AI Testing", "Testland", "42"))
    third = run(store, changed, "r3")
    assert third.error is None
    assert (third.tables[0].load.inserted_rows, third.tables[0].load.updated_rows) == (1, 40)
    companies = store.read("companies")
    assert companies.count() == 41
    assert companies.filter("id = '15'").first()["current_employees"] == 9999
    # '2026.0' is not an integer text: the default takes its place.
    assert companies.filter("id = '999999'").first()["year_founded"] == 1900
    assert companies.filter("_record_hash IS NULL OR length(_record_hash) != 64").count() == 0
    assert store.read("industry_stats").filter("length(_record_hash) != 32").count() == 0
    testing = store.read("industry_stats").filter("industry = 'AI TESTING'").first()
    assert testing["company_count"] == 1
    share = store.read("country_industry_summary").filter("industry = 'AI TESTING'").first()
    assert share["percent_of_global"] == 1.0
    assert index_counts(store) == {"companies": 41, "industry_stats": 7}
    assert store.read("etl_semantic_index").filter("run_id != 'r3'").count() == 0

    records = audit.run_records(store.read("etl_run_tracking"))
    latest = audit.recent_runs(records, 1).first()
    assert (latest["run_id"], latest["status"], latest["total_rows_loaded"]) == ("r3", "completed", 41)
    assert (latest["source_count"], latest["table_count"]) == (1, 3)
    assert latest["duration_seconds"] > 0
    events = audit.lineage_of(store.read("etl_lineage"), run_id="r3").collect()
    assert [e["event_type"] for e in events] == ["file", "hook", "output", "output", "output", "output", "output"]
    assert events[-1]["target_ref"] == "semantic::industry_semantics"


@pytest.fixture
def backups(tmp_path):
    import sqlite3

    folder = tmp_path / "backups"
    folder.mkdir()
    path = folder / "companies.db"
    con = sqlite3.connect(path)
    con.execute(
        "CREATE TABLE companies (id TEXT, name TEXT, year_founded TEXT, industry TEXT, country TEXT, current_employees TEXT)"
    )
    con.executemany("INSERT INTO companies VALUES (?, ?, ?, ?, ?, ?)", FIRST)
    con.commit()
    yield folder, con
    con.close()


def test_load_from_sqlite_files(store, backups):
    folder, con = backups
    source = sqlite_source(
        "backups",
        str(folder),
        "SELECT rowid AS row, * FROM companies",
        include=["*.db"],
        select=select_latest,
        split_column="row",
        splits=3,
    )
    table = CanonicalTable(COMPANIES, (source,), before_validation=(Transform(clean_companies),))
    first = run(store, FIRST, "r1", canonical=[table])
    assert first.error is None and first.rows_loaded == 40
    row = store.read("companies").first()
    assert row["_source_file"] == str(folder / "companies.db") and len(row["_file_hash"]) == 64
    con.execute("UPDATE companies SET current_employees = '9999' WHERE id = '15'")
    con.execute("INSERT INTO companies VALUES ('99', 'New', '2026.0', 'AI', 'T', '42')")
    con.commit()
    second = run(store, FIRST, "r2", canonical=[table])
    assert (second.tables[0].load.inserted_rows, second.tables[0].load.updated_rows) == (1, 40)
    assert store.read("companies").filter("id = '15'").first()["current_employees"] == 9999
    assert index_counts(store) == {"companies": 41, "industry_stats": 7}


def test_sqlite_files_with_a_schema_are_one_scan(spark, backups):
    folder, _ = backups
    sql = "SELECT id, name FROM companies"
    typed = sqlite_source("s", str(folder), sql, schema="id string, name string").read(spark)
    found = sqlite_source("s", str(folder), sql).read(spark)
    assert sorted(typed[0].collect()) == sorted(found[0].collect())
    assert typed[0].columns == ["id", "name", "_file_hash", "_source_file"]
    assert sqlite_source("s", str(folder), sql, include=["*.none"]).read(spark) == []


def test_load_from_csv_files(store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("id;name;current_employees\n1;x;5\n2;y;6\n")
    (folder / "b.csv").write_text("id;name;current_employees\n3;z;bad\n")
    (folder / "c.txt").write_text("other")
    source = file_source(
        "drop",
        str(folder),
        "csv",
        include=["*.csv"],
        sql="SELECT id, upper(name) AS name, current_employees, _source_file FROM {source}",
        read_options={"delimiter": ";"},
    )
    table = CanonicalTable(COMPANIES, (source,), check_types=True)
    result = run(store, FIRST, "r1", canonical=[table], derived=[], documents=[])
    assert result.error is None and (result.rows_loaded, result.rows_invalid) == (2, 1)
    loaded = {r["id"]: (r["name"], r["_source_file"]) for r in store.read("companies").collect()}
    assert loaded == {"1": ("X", str(folder / "a.csv")), "2": ("Y", str(folder / "a.csv"))}
    loaded = store.read("companies").select(F.col("_file_hash").alias("content_hash")).distinct()
    fresh = file_source("drop", str(folder), "csv", include=["*.csv"], known=loaded, read_options={"delimiter": ";"})
    assert [r["id"] for r in fresh.read(store.spark)[0].collect()] == ["3"]
    nothing = file_source("none", str(folder), "csv", include=["*.nothing"])
    result = run(store, FIRST, "r2", canonical=[CanonicalTable(COMPANIES, (nothing,))], derived=[], documents=[])
    assert "Batch frame is None" in result.tables[0].error


def test_invalid_rows_are_quarantined(store):
    data = [*FIRST, FIRST[0], (None, "no id", "1", "i", "x", "1"), ("77", "n", "1", "i", "x", "-5")]
    frame = store.spark.createDataFrame(data, LAYOUT)
    table = CanonicalTable(
        COMPANIES,
        (Source("a", lambda spark: frame),),
        before_validation=(Transform(clean_companies),),
        rules=lambda df: [non_negative("current_employees")],
    )
    result = run(store, data, "r1", canonical=[table], derived=[], documents=[])
    assert (result.rows_loaded, result.rows_invalid) == (39, 4)
    bad = store.read("etl_dlq").filter("run_id = 'r1' AND table_name = 'companies'")
    assert sorted(r["error_message"] for r in bad.collect()) == [
        "Column 'current_employees' is negative.",
        "Column 'id' is required but null.",
        "Duplicate primary key on columns ['id'].",
        "Duplicate primary key on columns ['id'].",
    ]


def test_schema_gate_stops_the_table(store):
    frame = store.spark.createDataFrame([("x",)], "name string")
    table = CanonicalTable(COMPANIES, (Source("a", lambda spark: frame),))
    result = run(store, FIRST, "r1", canonical=[table], derived=[], documents=[])
    assert result.error == CHILD_ERRORS
    assert "Schema validation failed" in result.tables[0].error
    assert (result.tables[0].held_rows, result.tables[0].valid_rows) == (1, 0)
    assert not store.exists("companies")
    failed = audit.get_run(audit.run_records(store.read("etl_run_tracking")), "r1").first()
    assert (failed["status"], failed["error_message"]) == ("failed", CHILD_ERRORS)


def test_the_gate_holds_one_source_and_lets_the_other_in(store):
    spec = TableSpec("names", (Column("id", key=True), Column("name")), load_mode="upsert")
    whole = store.spark.createDataFrame([("1", "x"), ("2", "y")], "id string, name string")
    sources = Source("a", lambda spark: whole.drop("id")), Source("b", lambda spark: whole)
    result = run(
        store, FIRST, "r1", canonical=[CanonicalTable(spec, sources)], derived=[], documents=[]
    )
    assert [(r.source_id, r.held_rows, r.valid_rows) for r in result.tables] == [("a", 2, 0), ("b", 0, 2)]
    assert store.read("names").count() == 2


def test_a_failing_table_leaves_the_others(store):
    twice = TableSpec("twice", (Column("id", key=True),), kind="derived", depends_on=("companies",))
    derived = [
        DerivedTable(twice, lambda f: f["companies"].select(F.lit("same").alias("id"))),
        DerivedTable(INDUSTRIES, industry_stats),
    ]
    absent = DocumentSpec("absent", "no_table", "x")
    result = run(store, FIRST, "r1", derived=derived, documents=[absent, DOCUMENTS[0]])
    by_name = {r.table_name: r.error for r in result.tables}
    assert by_name["companies"] is None and by_name["industry_stats"] is None
    assert "Duplicate primary key" in by_name["twice"]
    assert result.indexes[0].error and result.indexes[1].error is None
    loaded = {r["table_name"]: r["total_affected"] for r in load_results(store.spark, result).collect()}
    assert loaded == {"companies": 40, "twice": 0, "industry_stats": 6}


def test_derived_values_must_fit_their_types(store):
    spec = TableSpec(
        "halves", (Column("id", key=True), Column("n", "int")), kind="derived", depends_on=("companies",)
    )
    build = DerivedTable(spec, lambda f: f["companies"].select("id", F.lit(0.5).alias("n")))
    result = run(store, FIRST, "r1", derived=[build], documents=[])
    assert result.tables[1].error == "Column 'n' is not a valid int."
    assert not store.exists("halves")


def test_sources_with_different_columns_are_united(store):
    spark = store.spark
    a = spark.createDataFrame(FIRST[:2], LAYOUT).withColumns(
        {"_file_hash": F.lit("h"), "_source_file": F.lit("/a")}
    )
    b = spark.createDataFrame([(3, "z")], "id int, name string")
    spec = TableSpec("companies", COMPANIES.columns, load_mode="replace", dedupe_before_load=True)
    table = CanonicalTable(
        spec,
        (Source("a", lambda s: [a, a]), Source("b", lambda s: b)),
        before_load=(Transform(clean_companies),),
    )
    result = run(store, FIRST, "r1", canonical=[table], derived=[], documents=[])
    assert result.error is None and result.rows_loaded == 3
    files = {r["id"]: r["_source_file"] for r in store.read("companies").collect()}
    assert files == {"1": "/a", "2": "/a", "3": "unknown"}


def test_empty_projection_keeps_stored_chunks(store):
    run(store, FIRST, "r1")
    empty = CanonicalTable(
        TableSpec("companies", COMPANIES.columns, load_mode="replace", record_hash=True),
        (Source("a", lambda s: s.createDataFrame([], LAYOUT)),),
    )
    result = run(store, FIRST, "r2", canonical=[empty], derived=[], documents=[DOCUMENTS[0]])
    assert result.indexes[0].error.startswith("No documents projected")
    assert index_counts(store)["companies"] == 40


def test_allowed_empty_projection_drops_the_chunks(store, scratch):
    run(store, FIRST, "r1")
    store.rewrite("companies", store.read("companies").filter("false"))
    log = audit.LineageLog("r2")
    result = load_index(
        store, DOCUMENTS[0], run_id="r2", scratch=scratch, lineage=log, allow_empty=True
    )
    assert result.error is None and index_counts(store) == {"industry_stats": 6}


def test_equal_rows_make_one_document(store, scratch):
    df = store.spark.createDataFrame([("a",), ("a",), ("b",)], "name string")
    store.append_rows("plain", df)
    spec = DocumentSpec("plain_docs", "plain", "{name}")
    log = audit.LineageLog("r1")
    result = load_index(store, spec, run_id="r1", scratch=scratch, lineage=log, unique_rows=False)
    assert (result.documents, result.chunks) == (2, 2)


def test_rows_that_cannot_be_rendered_are_counted(store, scratch):
    df = store.spark.createDataFrame([(1.5,), (None,)], "x double")
    store.append_rows("plain", df)
    log = audit.LineageLog("r1")
    spec = DocumentSpec("plain_docs", "plain", "{x:.2f}")
    result = load_index(store, spec, run_id="r1", scratch=scratch, lineage=log)
    assert (result.documents, result.failed_rows, result.error) == (1, 1, None)
    unknown = DocumentSpec("plain_docs", "plain", "{x}", id_strategy="by_guess")
    result = load_index(store, unknown, run_id="r2", scratch=scratch, lineage=log)
    assert (result.documents, result.failed_rows) == (0, 2) and result.error
    assert store.read("etl_semantic_index").count() == 1


def test_foreign_keys_are_reported(store):
    run(store, FIRST, "r1", documents=[])
    assert foreign_key_report(store, SUMMARY).count() == 0
    store.rewrite("industry_stats", store.read("industry_stats").filter("industry != 'I1'"))
    found = foreign_key_report(store, SUMMARY).collect()
    assert [(r["key"], r["child_rows"]) for r in found] == [('{"industry":"I1"}', 3)]
    assert foreign_key_report(store, COMPANIES) is None


def test_retention(store):
    run(store, FIRST, "r1", derived=[], documents=[])
    apply_retention(store, 1)
    assert store.read("etl_run_tracking").count() == 2
    apply_retention(store, 0)
    assert store.read("etl_run_tracking").count() == 0
    assert store.read("etl_lineage").count() == 0


def test_build_order():
    ordered = [t.spec.name for t in build_order([DerivedTable(SUMMARY, summary), DerivedTable(INDUSTRIES, industry_stats)])]
    assert ordered == ["industry_stats", "country_industry_summary"]
    a = TableSpec("a", (Column("x"),), kind="derived", depends_on=("b",))
    b = TableSpec("b", (Column("x"),), kind="derived", depends_on=("a",))
    with pytest.raises(ValueError):
        build_order([DerivedTable(a, industry_stats), DerivedTable(b, industry_stats)])


def test_run_records(spark):
    start = audit.run_event(spark, "r", "p", "started")
    again = audit.run_event(spark, "r", "p", "started")
    record = audit.run_records(start.unionByName(again)).first()
    assert (record["status"], record["completed_at"], record["total_rows_loaded"]) == ("started", None, 0)
    assert record["started_at"] == start.first()["at"]
    done = audit.run_event(spark, "r", "p", "completed", sources=1, tables=2, loaded=500, invalid=3)
    record = audit.run_records(start.unionByName(done)).first()
    assert (record["status"], record["source_count"], record["table_count"]) == ("completed", 1, 2)
    assert (record["total_rows_loaded"], record["total_rows_invalid"]) == (500, 3)
    failed = audit.run_event(spark, "e", "p", "failed", error="ConnectionError: gone")
    records = audit.run_records(start.unionByName(failed))
    assert "ConnectionError" in audit.get_run(records, "e").first()["error_message"]
    assert audit.get_run(records, "none").first() is None
    with pytest.raises(ValueError):
        audit.recent_runs(records, -1)
    with pytest.raises(ValueError):
        audit.run_event(spark, "r", "p", "paused")


def test_lineage_order_and_filters(spark):
    log = audit.LineageLog("r1")
    log.file("/a.db", "t")
    log.hook("normalize", "post_read", "t")
    log.stage("post_read", "t")
    log.output("t", "t")
    log.output("u", "u", "derive")
    events = audit.lineage_of(log.frame(spark), run_id="r1")
    assert [e["event_type"] for e in events.collect()] == ["file", "hook", "stage", "output", "output"]
    assert audit.lineage_of(log.frame(spark), table_name="u").count() == 1
    assert audit.lineage_of(log.frame(spark), run_id="r2").count() == 0


def test_totals_and_retention(spark):
    loads = spark.createDataFrame(
        [
            ("r", "s", "a", "canonical", "upsert", 2, 3, 5, 1, None),
            ("r", "s", "b", "derived", "replace", 9, 0, 9, 0, None),
            ("r", "s", "c", "canonical", None, 0, 0, 0, 0, "broken"),
        ],
        audit.LOAD_SCHEMA,
    )
    assert tuple(audit.run_totals(loads).first()) == ("r", 5, 1, 3, 1)
    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1),), (dt.datetime(2024, 3, 1),)], "at timestamp_ntz")
    assert audit.younger_than(rows, "at", 30, now=dt.datetime(2024, 3, 10)).count() == 1
