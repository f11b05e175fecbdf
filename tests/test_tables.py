from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from millrace.sources.tables import KeyCollision, bucket_count
from millrace.spec import Column, TableSpec

KEYED = TableSpec(
    "t",
    (Column("k", "int", key=True), Column("v", "str", indexed=True)),
    kind="derived",
    depends_on=("x",),
    buckets=4,
)
LAYOUT = "k long, v string"


def batch(spark, *pairs):
    return spark.createDataFrame(list(pairs), LAYOUT)


def test_append_and_collision(spark, store, rows):
    assert store.write(KEYED, batch(spark, (1, "a"), (2, "b")), "append").inserted_rows == 2
    assert store.write(KEYED, batch(spark, (3, "c")), "append").total_affected == 1
    with pytest.raises(KeyCollision):
        store.write(KEYED, batch(spark, (3, "x"), (4, "y")), "append")
    assert rows(store.read("t")) == [(1, "a"), (2, "b"), (3, "c")]


def test_replace(spark, store, rows):
    store.write(KEYED, batch(spark, (1, "a")), "replace")
    result = store.write(KEYED, batch(spark, (2, "b"), (3, "c")), "replace")
    assert (result.inserted_rows, result.updated_rows) == (2, 0)
    assert rows(store.read("t")) == [(2, "b"), (3, "c")]


def test_upsert_counts_every_known_key_as_updated(spark, store, rows):
    first = store.write(KEYED, batch(spark, (1, "a"), (2, "b")), "upsert")
    assert (first.inserted_rows, first.updated_rows) == (2, 0)
    second = store.write(KEYED, batch(spark, (2, "b"), (3, "c")), "upsert")
    assert (second.inserted_rows, second.updated_rows) == (1, 1)
    empty = store.write(KEYED, batch(spark, (9, "z")).filter("false"), "upsert")
    assert empty.total_affected == 0
    assert rows(store.read("t")) == [(1, "a"), (2, "b"), (3, "c")]


def test_upsert_leaves_other_buckets_alone(spark, store):
    store.write(KEYED, spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v")), "upsert")
    before = set(store._commit("t").folders)
    store.write(KEYED, batch(spark, (5, "b")), "upsert")
    after = set(store._commit("t").folders)
    assert len(before & after) == 3 and len(after) == 4
    assert store.read("t").count() == 100


def test_stored_bucket_count_is_kept(spark, store):
    many = spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("v"))
    store.write(KEYED, many, "upsert")
    other = replace(KEYED, buckets=7)
    result = store.write(other, many.withColumn("v", F.lit("b")), "upsert")
    assert (result.inserted_rows, result.updated_rows) == (0, 100)
    assert store.read("t").filter("v = 'b'").count() == store.read("t").count() == 100
    with pytest.raises(KeyCollision):
        store.write(other, many, "append")
    store.write(other, many, "replace")
    assert len(store._commit("t").folders) == 7


def test_buckets_follow_the_size(spark, store, scratch, monkeypatch):
    spec = replace(KEYED, buckets=None)
    wide = F.sha2(F.col("id").cast("string"), 256)
    small = scratch.stage(spark.range(50).select(F.col("id").alias("k"), wide.alias("v")))
    large = scratch.stage(spark.range(5000).select(F.col("id").alias("k"), wide.alias("v")))
    store.write(spec, small, "upsert")
    assert len(store._commit("t").folders) == 1
    monkeypatch.setattr("millrace.sources.tables.BUCKET_BYTES", 100_000)
    result = store.write(spec, large, "upsert")
    assert (result.inserted_rows, result.updated_rows) == (4950, 50)
    grown = len(store._commit("t").folders)
    assert grown > 2
    again = store.write(spec, small, "upsert")
    assert (again.inserted_rows, again.updated_rows) == (0, 50)
    assert store.read("t").count() == store.read("t").select("k").distinct().count() == 5000
    unknown = store.write(replace(spec, name="u"), batch(spark, (1, "a")), "upsert")
    assert unknown.inserted_rows == 1 and store._commit("u").buckets == 1


def test_stored_table_with_another_layout_is_refused(spark, store):
    store.write(KEYED, batch(spark, (1, "a")), "upsert")
    wider = replace(KEYED, columns=(*KEYED.columns, Column("w", "int")))
    df = spark.createDataFrame([(1, "a", 2)], "k long, v string, w long")
    with pytest.raises(ValueError, match="stored with other columns"):
        store.write(wider, df, "upsert")
    assert store.write(wider, df, "replace").inserted_rows == 1
    rekeyed = replace(wider, primary_key=("v",))
    with pytest.raises(ValueError, match="another key"):
        store.write(rekeyed, df, "upsert")


def test_upsert_without_key_appends(spark, store):
    spec = TableSpec("n", (Column("v", "str"),), kind="derived", depends_on=("x",))
    df = spark.createDataFrame([("a",)], "v string")
    store.write(spec, df, "upsert")
    assert store.write(spec, df, "upsert").inserted_rows == 1
    assert store.read("n").count() == 2


def test_null_keys_are_inserted_again(spark, store):
    spec = TableSpec(
        "o",
        (Column("k", "int", key=True, nullable=True), Column("v", "str")),
        kind="derived",
        depends_on=("x",),
        buckets=3,
    )
    df = batch(spark, (None, "a"), (1, "b"))
    store.write(spec, df, "upsert")
    result = store.write(spec, df, "upsert")
    assert (result.inserted_rows, result.updated_rows) == (1, 1)
    assert store.read("o").count() == 3


def test_empty_table_keeps_its_columns(spark, store):
    store.write(KEYED, batch(spark, (1, "a")).filter("false"), "replace")
    empty = store.read("t")
    assert empty.columns == ["k", "v"] and empty.count() == 0
    with pytest.raises(FileNotFoundError):
        store.read("absent")
    with pytest.raises(ValueError, match="columns of the table"):
        store.write(KEYED, spark.createDataFrame([(1, "a")], "k int, v string"))
    with pytest.raises(ValueError, match="Unsupported"):
        store.write(KEYED, batch(spark, (1, "a")), "shuffle")


def test_reader_keeps_its_version(spark, store, rows):
    store.write(KEYED, batch(spark, (1, "a")), "replace")
    old = store.read("t")
    store.write(KEYED, batch(spark, (1, "b")), "replace")
    assert rows(old) == [(1, "a")] and rows(store.read("t")) == [(1, "b")]
    assert store.remove_dead("t") == 1
    assert rows(store.read("t")) == [(1, "b")]


def test_lost_commit_is_passed_over(spark, store, rows):
    store.write(KEYED, batch(spark, (1, "a")), "replace")
    spark.range(0).selectExpr("string(id) AS value").write.text(
        f"{store.root}/t/commits/v={2:012d}"
    )
    assert rows(store.read("t")) == [(1, "a")]
    store.write(KEYED, batch(spark, (2, "b")), "upsert")
    assert rows(store.read("t")) == [(1, "a"), (2, "b")]


def test_second_writer_of_a_version_fails(spark, store):
    store.write(KEYED, batch(spark, (1, "a")), "replace")
    with pytest.raises(Exception, match="exists already"):
        store._publish("t", 1, KEYED.schema(), [])


def test_partitions(spark, store, rows):
    df = spark.createDataFrame([("a/b", 1), ("a/b", 2), ("c d", 3)], "s string, v int")
    store.append_rows("p", df, "s")
    assert store.replace_partition("p", df.filter("v = 1"), "s", "a/b")
    assert not store.replace_partition("p", df.filter("v = 9"), "s", "a/b")
    assert rows(store.read("p")) == [("a/b", 1), ("c d", 3)]
    assert store.drop_partition("p", "c d") == 1
    assert store.drop_partition("p", "c d") == 0
    assert rows(store.read("p")) == [("a/b", 1)]


def test_a_bucket_fits_one_merging_task(spark, monkeypatch):
    """324 MB, such as 5.4 million clients take, are dealt between a dozen tasks or so."""
    spec = TableSpec("t", (Column("id", key=True),), load_mode="upsert")
    monkeypatch.setattr("millrace.sources.tables.planned_bytes", lambda frame: 324_000_000)
    frame = spark.range(1)
    assert bucket_count(spec, frame) >= 10
    assert bucket_count(spec, frame, frame) >= 20


def test_large_buckets_are_merged_in_parts(spark, store, scratch, monkeypatch):
    """Two stated buckets of a few hundred kB, with parts of 50 kB: many tasks write each."""
    spec = replace(KEYED, buckets=2)
    wide = F.sha2(F.col("id").cast("string"), 256)
    rows = scratch.stage(spark.range(10000).select(F.col("id").alias("k"), wide.alias("v")))
    store.write(spec, rows, "upsert")
    monkeypatch.setattr("millrace.sources.tables.BUCKET_BYTES", 50_000)
    result = store.write(spec, rows, "upsert")
    assert (result.inserted_rows, result.updated_rows) == (0, 10000)
    stored = store.read("t")
    assert len(store._commit("t").folders) == 2
    assert sorted(stored.collect()) == sorted(rows.collect())
    assert stored.select(F.input_file_name()).distinct().count() > 8
