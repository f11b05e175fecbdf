import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.lookups import hot_keys, join_lookup
from millrace.operators.merge import (
    changed_rows,
    insert_absent,
    key_collisions,
    merge_buckets,
    merge_counts,
    merge_rows,
    orphan_keys,
    orphan_rows,
)

TARGET = [(1, "a"), (2, "b"), (None, "n")]
BATCH = [(2, "B"), (3, "c"), (None, "m")]
LAYOUT = "k int, v string"


def test_merge(spark, rows):
    target, batch = spark.createDataFrame(TARGET, LAYOUT), spark.createDataFrame(BATCH, LAYOUT)
    merged = [(1, "a"), (2, "B"), (3, "c"), (None, "m"), (None, "n")]
    assert rows(merge_rows(target, batch, ["k"], nullable_key=True)) == merged
    assert rows(merge_rows(target, batch, ["k"])) == merged
    assert len(rows(merge_rows(target, batch, []))) == 6
    kept = [(1, "a"), (2, "b"), (3, "c"), (None, "m"), (None, "n")]
    assert rows(insert_absent(target, batch, ["k"], nullable_key=True)) == kept
    assert rows(key_collisions(target, batch, ["k"])) == [(2,)]


def test_merge_with_only_key_columns_inserts_absent_keys(spark, rows):
    target, batch = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(merge_rows(target, batch, ["k"])) == [(1,), (2,), (3,)]


def test_merge_buckets_equals_merge(spark, rows):
    rng = random.Random(5)
    stored = [(k % 5, k, f"s{k}") for k in rng.sample(range(300), 150)]
    batch = [(k % 5, k, f"b{k}") for k in rng.sample(range(300), 150)]
    loose = [(i % 5, None, f"l{i}") for i in range(20)]
    layout = "b int, k int, v string"
    a = spark.createDataFrame(stored + loose, layout)
    b = spark.createDataFrame(batch + loose, layout)
    got = rows(merge_buckets(a, b, ["k"], "b", nullable_key=True))
    assert got == rows(merge_rows(a, b, ["k"], nullable_key=True))


@pytest.mark.parametrize("parts", [1, 3])
def test_a_merging_task_holds_a_part_of_one_bucket(spark, rows, parts):
    """By their hashes, or put together at run time, several buckets would share a task."""
    a = spark.range(6000).selectExpr("cast(pmod(xxhash64(id), 6) as int) b", "id k", "'s' v")
    b = a.filter("k % 2 = 0").withColumn("v", F.lit("b"))
    merged = merge_buckets(a, b, ["k"], "b", n_buckets=6, parts=parts)
    assert rows(merged.groupBy("v").count()) == [("b", 3000), ("s", 3000)]
    tasks = merged.groupBy(F.spark_partition_id().alias("task")).agg(
        F.count_distinct("b").alias("buckets"), F.count("*").alias("n")
    ).collect()
    assert len(tasks) == 6 * parts
    assert all(t["buckets"] == 1 and t["n"] < 1.3 * 1000 / parts for t in tasks)


def test_merge_buckets_shuffles_once(spark):
    a = spark.createDataFrame([(0, 1, "a")], "b int, k int, v string")
    plan = merge_buckets(a, a, ["k"], "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_counts_and_changes(spark, rows):
    layout = "k int, _record_hash string"
    target = spark.createDataFrame([(1, "x"), (2, "y")], layout)
    batch = spark.createDataFrame([(1, "x"), (2, "z"), (3, "w")], layout)
    counted = merge_counts(target, batch, ["k"], hash_column="_record_hash").first()
    assert tuple(counted) == (1, 2, 1)
    assert tuple(merge_counts(target, batch, ["k"]).first()) == (1, 2)
    assert rows(changed_rows(target, batch, ["k"])) == [(2, "z"), (3, "w")]


def test_orphans(spark, scratch, no_broadcast, rows):
    child = spark.createDataFrame([(1, "a")] * 9 + [(2, "b"), (3, "c"), (None, "d")], "fk int, v string")
    parent = spark.createDataFrame([(2,)], "id int")
    assert rows(orphan_keys(child, parent, ["fk"], ["id"])) == [(1, 9), (3, 1)]
    for hot in (2, 100):
        got = rows(orphan_rows(child, parent, ["fk"], ["id"], scratch=scratch, hot_rows=hot))
        assert got == [(1, "a")] * 9 + [(3, "c")]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
@pytest.mark.parametrize("null_safe", [True, False])
def test_lookup_with_hot_keys_equals_plain_join(spark, scratch, no_broadcast, rows, how, null_safe):
    data = [(1, i) for i in range(30)] + [(None, 90 + i) for i in range(20)] + [(k, 0) for k in range(2, 9)]
    data += [(99, i) for i in range(25)]
    left = spark.createDataFrame(data, "k int, v int")
    lookup = spark.createDataFrame([(1, "one"), (None, "null"), (3, "three"), (50, "x")], "k int, name string")
    found = join_lookup(left, lookup, ["k"], scratch=scratch, how=how, null_safe=null_safe, hot_rows=10)
    names = {1: "one", 3: "three", 50: "x", **({None: "null"} if null_safe else {})}
    expected = {
        "left": [(k, v, names.get(k)) for k, v in data],
        "inner": [(k, v, names[k]) for k, v in data if k in names],
        "left_semi": [(k, v) for k, v in data if k in names],
        "left_anti": [(k, v) for k, v in data if k not in names],
    }[how]
    assert rows(found) == sorted(expected, key=repr)


def test_hot_keys(spark, scratch, rows):
    left = spark.createDataFrame([(1,)] * 5 + [(2,)] * 2, "k int")
    assert rows(hot_keys(left, ["k"], scratch, hot_rows=3)) == [(1,)]
