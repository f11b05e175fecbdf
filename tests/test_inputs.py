import fnmatch
import hashlib
import io
import os
import sqlite3

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.plans.inputs import file_source, scan_alike
from millrace.sources import files as f
from millrace.sources import schemas
from millrace.sources.scan import query, scan, with_file_hash
from millrace.sources.schemas import file_columns, fold_schemas
from millrace.sources.sqlite import sqlite_query


@pytest.fixture
def folder(tmp_path):
    names = ["a.csv", "B.CSV", "b1.txt", "b2.txt", "noext", "sub/c.csv", "sub/deep/x y+z.csv"]
    for i, name in enumerate(names):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"k,v\n%d,%s\n" % (i, name.encode()))
        os.utime(path, (1_700_000_000 + (i % 3), 1_700_000_000 + (i % 3)))
    return tmp_path


def names_in(df, column="relative_path"):
    return [r[column] for r in df.collect()]


def test_inventory(spark, folder):
    files = f.inventory(spark, str(folder), source_id="s")
    assert names_in(files) == ["a.csv", "B.CSV", "b1.txt", "b2.txt", "noext"]
    first = files.first()
    assert first["path"] == str(folder / "a.csv")
    assert first["content_hash"] == hashlib.sha256((folder / "a.csv").read_bytes()).hexdigest()
    assert (first["suffix"], first["size_bytes"], first["source_id"]) == (".csv", 12, "s")
    assert names_in(files, "suffix") == [".csv", ".csv", ".txt", ".txt", ""]
    everything = f.inventory(spark, str(folder), recursive=True)
    assert names_in(everything)[-2:] == ["sub/c.csv", "sub/deep/x y+z.csv"]


def test_missing_folders_fail(spark, folder):
    with pytest.raises(FileNotFoundError):
        f.list_files(spark, str(folder / "absent"))
    with pytest.raises(NotADirectoryError):
        f.list_files(spark, str(folder / "a.csv"))


@pytest.mark.parametrize("pattern", ["*.csv", "b?.txt", "b[12].txt", "b[!1].*", "sub/*", "*", "a.csv", "[x]", "*+z*"])
def test_patterns_agree_with_fnmatch(spark, folder, pattern):
    everything = f.list_files(spark, str(folder), recursive=True).collect()

    def hit(r):
        return fnmatch.fnmatchcase(r["file_name"], pattern) or fnmatch.fnmatchcase(r["relative_path"], pattern)

    included = f.list_files(spark, str(folder), recursive=True, include=[pattern])
    assert sorted(names_in(included)) == sorted(r["relative_path"] for r in everything if hit(r))
    excluded = f.list_files(spark, str(folder), recursive=True, exclude=[pattern])
    assert sorted(names_in(excluded)) == sorted(r["relative_path"] for r in everything if not hit(r))


def test_large_files_are_hashed_in_blocks(spark, folder):
    files = f.list_files(spark, str(folder), recursive=True)
    by_cell = f.with_content_hash(files)
    by_block = f.with_content_hash(files, max_cell_bytes=12)
    both = [{r["path"]: r["content_hash"] for r in df.collect()} for df in (by_cell, by_block)]
    assert both[0] == both[1] and len(both[0]) == 7


def test_names_that_look_like_patterns(spark, tmp_path):
    for name in ("a[1].csv", "b{x,y}.csv", "c*.csv", "d e%20.csv"):
        (tmp_path / name).write_text("k\n1\n")
    files = f.inventory(spark, str(tmp_path))
    assert files.count() == 4
    paths = [f.loadable(p) for p in names_in(files, "path")]
    read = scan(spark, paths, "csv")
    assert sorted(names_in(read, "_source_file")) == sorted(names_in(files, "path"))


def test_selection(spark, folder):
    files = f.list_files(spark, str(folder), source_id="s", recursive=True)
    # b1.txt and c.csv share the latest time: the greater path wins.
    assert names_in(f.select_latest(files)) == ["sub/c.csv"]
    two = f.select_latest_per_source(files, 2)
    assert sorted(names_in(two)) == ["b1.txt", "sub/c.csv"]
    assert names_in(f.select_named(files, r"^b1")) == ["b1.txt"]
    assert f.select_all(files).count() == 7
    middle = files.agg(F.min("modified_at")).first()[0]
    assert f.select_changed_between(files, end=middle).count() == 0
    assert f.select_changed_between(files, start=middle).count() == 7
    assert f.select_latest(files.filter("false")).count() == 0


def test_skip_known(spark, folder):
    files = f.inventory(spark, str(folder))
    left = f.skip_known(files, files.filter("file_name LIKE 'b%'"))
    assert sorted(names_in(left)) == ["B.CSV", "a.csv", "noext"]


def test_groups(spark, folder, rows):
    files = f.list_files(spark, str(folder), source_id="s", recursive=True)
    assert rows(f.group_summary(f.group_single(files)).select("group_id", "asset_count")) == [("s__single_group", 7)]
    parents = f.group_summary(f.group_by_parent(files)).select("group_id", "asset_count")
    assert rows(parents) == [("s__", 5), ("s__sub", 1), ("s__sub/deep", 1)]
    by_name = f.group_summary(f.group_by_name(files, r"\.(\w+)$")).select("group_id", "asset_count")
    assert rows(by_name) == [("s__", 1), ("s__CSV", 1), ("s__csv", 3), ("s__txt", 2)]
    assert f.group_by_day(files).select("group_id").distinct().count() == 1
    assert f.group_summary(f.group_single(files.filter("false"))).count() == 0


def test_scan_and_hashes(spark, folder, scratch, rows):
    files = f.inventory(spark, str(folder), recursive=True, include=["*.csv"])
    read = scan(spark, names_in(files, "path"), "csv", schema="k int, v string")
    hashed = with_file_hash(read, files, scratch=scratch)
    for row in hashed.collect():
        data = open(row["_source_file"], "rb").read()
        assert row["_file_hash"] == hashlib.sha256(data).hexdigest()
    assert sorted(r["v"] for r in hashed.collect()) == ["a.csv", "sub/c.csv", "sub/deep/x y+z.csv"]
    unknown = with_file_hash(read, files.filter("false"), scratch=scratch)
    assert {r["_file_hash"] for r in unknown.collect()} == {"unknown"}


def test_many_files_take_the_skew_safe_join(spark, folder, scratch, no_broadcast):
    files = f.inventory(spark, str(folder), recursive=True, include=["*.csv"])
    read = scan(spark, names_in(files, "path"), "csv", schema="k int, v string")
    assert with_file_hash(read, files, scratch=scratch).filter("_file_hash != 'unknown'").count() == 3


def test_csv_options(spark, tmp_path, rows):
    path = tmp_path / "x.csv"
    path.write_bytes("1;é\n2;b\n".encode("latin-1"))
    read = scan(spark, str(path), "csv", delimiter=";", encoding="ISO-8859-1", header_row=False)
    assert rows(read.drop("_source_file")) == [("1", "é"), ("2", "b")]
    with pytest.raises(ValueError):
        scan(spark, str(path), "xlsx")


def test_query(spark, rows):
    df = spark.createDataFrame([(1,), (2,)], "a int")
    assert rows(query(spark, "SELECT a + 1 AS b FROM {t} WHERE a > 1", {"t": df})) == [(3,)]
    with pytest.raises(ValueError):
        query(spark, "  ", {})


@pytest.fixture
def databases(tmp_path):
    paths = []
    for n in range(2):
        path = tmp_path / f"d{n}.db"
        con = sqlite3.connect(path)
        con.execute("CREATE TABLE c (id INTEGER PRIMARY KEY, name TEXT, score REAL, mixed)")
        con.executemany(
            "INSERT INTO c VALUES (?, ?, ?, ?)",
            [(n * 1000 + i * 3, f"n{i}" if i % 5 else None, i / 2, i if i % 2 else "t") for i in range(50)],
        )
        con.commit()
        con.close()
        paths.append(str(path))
    return paths


@pytest.mark.parametrize("splits", [1, 3, 200])
def test_sqlite_query(spark, databases, rows, splits):
    sql = "SELECT id, upper(name) AS name, score, mixed FROM c WHERE score > 1;"
    df = sqlite_query(spark, databases, sql, split_column="id", splits=splits)
    assert [t for _, t in df.dtypes] == ["bigint", "string", "double", "string"]
    expected = [
        (n * 1000 + i * 3, f"N{i}" if i % 5 else None, i / 2, str(i) if i % 2 else "t")
        for n in range(2)
        for i in range(50)
        if i / 2 > 1
    ]
    assert rows(df) == sorted(expected, key=repr)
    assert df.rdd.getNumPartitions() == 2 * splits


def test_sqlite_split_column_with_nulls_and_no_rows(spark, databases):
    sql = "SELECT nullif(id % 7, 0) AS part FROM c"
    assert sqlite_query(spark, databases, sql, split_column="part", splits=4).count() == 100
    nothing = "SELECT id FROM c WHERE id < 0"
    assert sqlite_query(spark, databases, nothing, schema="id long", split_column="id", splits=4).count() == 0


def test_sqlite_errors(spark, tmp_path, databases):
    with pytest.raises(ValueError):
        sqlite_query(spark, databases, " ")
    with pytest.raises(Exception, match="not found"):
        sqlite_query(spark, str(tmp_path / "no.db"), "SELECT 1")


def test_sqlite_types_come_from_all_rows(spark, tmp_path, rows):
    path = str(tmp_path / "late.db")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE t (n, late, mixed, never)")
    data = [(i, None, i, None) for i in range(3000)] + [(2.5, 7, "x", None)]
    con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", data)
    con.commit()
    con.close()
    df = sqlite_query(spark, path, "SELECT * FROM t")
    assert [f.dataType.simpleString() for f in df.schema] == ["double", "bigint", "string", "string"]
    assert rows(df.filter("late = 7")) == [(2.5, 7, "x", None)]
    with pytest.raises(Exception, match="cannot hold 2.5"):
        sqlite_query(spark, path, "SELECT n FROM t", schema="n long").collect()


def test_listing_is_complete(spark, tmp_path):
    (tmp_path / "dt=1").mkdir()
    for name, content in (("a.csv", "x"), ("empty.csv", ""), ("_u.csv", "u"), (".h", "h"), ("dt=1/c.csv", "c")):
        (tmp_path / name).write_text(content)
    flat = f.inventory(spark, str(tmp_path))
    assert {r["relative_path"] for r in flat.collect()} == {"a.csv", "empty.csv", "_u.csv", ".h"}
    deep = {r["relative_path"]: r for r in f.inventory(spark, str(tmp_path), recursive=True).collect()}
    assert set(deep) == {"a.csv", "empty.csv", "_u.csv", ".h", "dt=1/c.csv"}
    for name, row in deep.items():
        assert row["content_hash"] == hashlib.sha256((tmp_path / name).read_bytes()).hexdigest()


def test_mixed_files_are_united(spark, tmp_path, rows):
    (tmp_path / "1.csv").write_text("id,name\n1,Ann\n")
    (tmp_path / "2.csv").write_text("name,id\nBob,2\n")
    (tmp_path / "3.csv").write_text("id,city\n3,Rome\n")
    (tmp_path / "4.csv").write_text("")
    (read,) = file_source("s", str(tmp_path), "csv", include=["*.csv"]).read(spark)
    assert rows(read.select("id", "name", "city")) == [
        ("1", "Ann", None), ("2", "Bob", None), ("3", None, "Rome")
    ]
    spark.createDataFrame([(1, "a")], "id int, name string").write.parquet(str(tmp_path / "p/x"))
    spark.createDataFrame([("k", 2)], "id string, more int").write.parquet(str(tmp_path / "p/y"))
    (read,) = file_source(
        "s", str(tmp_path / "p"), "parquet", recursive=True, include=["part-*.parquet"]
    ).read(spark)
    assert rows(read.select("id", "name", "more")) == [("1", "a", None), ("k", None, 2)]


def test_schemas_are_found_in_tasks(spark, scratch, tmp_path, rows):
    """Layouts of many files in a fixed number of jobs, and in as few scans as types allow."""
    layouts = [
        pa.table({"id": [1], "name": ["a"]}),
        pa.table({"name": ["b"], "id": [2]}),
        pa.table({"id": [3], "more": [0.5]}),
        pa.table({"id": ["x"], "name": ["c"]}),
        pa.table({"id": pa.array([4], pa.int32()), "deep": [{"a": 1, "b": [1, 2]}]}),
    ]
    for i in range(40):
        pq.write_table(layouts[i % 5], tmp_path / f"{i:02d}.parquet")
    (tmp_path / "none.parquet").write_bytes(b"")
    files = f.list_files(spark, str(tmp_path))
    found = file_columns(files, "parquet", scratch=scratch)
    kinds = sorted({r["columns"] for r in found.collect()})
    assert found.count() == 40 and len(kinds) == 4
    assert [len(members) for members in fold_schemas(kinds)].count(1) >= 1

    spark.sparkContext.setJobGroup("drift", "schemas of many files")
    read = scan_alike(files, "parquet", scratch=scratch)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("drift")) < 20
    assert read.count() == 40 and dict(read.dtypes)["id"] == "string"
    assert rows(read.filter("more IS NOT NULL").select("id", "name", "more").distinct()) == [("3", None, 0.5)]
    assert read.filter("deep.a = 1").count() == 8


def test_schemas_in_a_store_that_arrow_cannot_open(spark, scratch, tmp_path, rows, monkeypatch):
    for i, text in enumerate(["id,name\n1,Ann\n", "\r\n﻿name,id\r\nBob,2\r\n", "", "id,name\n3,Cy\n"]):
        (tmp_path / f"{i}.csv").write_text(text, newline="", encoding="utf-8")
    files = f.list_files(spark, str(tmp_path))
    want = [("0.csv", "id,name"), ("1.csv", "name,id"), ("3.csv", "id,name")]
    for closed in (False, True):
        # A path with a scheme unknown to Arrow; Spark resolves it as a local one.
        named = files.withColumn("path", F.concat(F.lit("viewfs:"), "path")) if closed else files
        if closed:
            monkeypatch.setattr(schemas, "loadable", lambda path: path.removeprefix("viewfs:"))
        found = file_columns(named, "csv", scratch=scratch)
        got = found.select(F.substring_index("path", "/", -1), "columns")
        assert rows(got) == want


@pytest.mark.parametrize("text, line", [
    (b"", None), (b"\n \n", None), (b"a;b", "a;b"), (b"\n\na,b\r\nc,d\n", "a,b"),
    (b"x" * 200_000 + b"\nrest", "x" * 200_000),
])
def test_header_lines(text, line):
    assert schemas.header_line(io.BytesIO(text), "utf-8") == line
