"""Differences of tables against counting rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators.difference import differing_ranges, row_difference

SCHEMA = "k string, n int, `a b` double"


def expected(left, right):
    source, target = Counter(left), Counter(right)
    return sorted(
        ((*row, source[row], target[row]) for row in source | target if source[row] != target[row]),
        key=repr,
    )


def random_rows(seed, size):
    draw = random.Random(seed)
    keys = [None, "", "hot", *map(str, range(60))]
    return [
        ("hot" if draw.random() < 0.3 else draw.choice(keys), draw.choice([None, 1, 2]),
         draw.choice([None, 0.5]))
        for _ in range(size)
    ]


@pytest.mark.parametrize("fan", [1, 2, 64, 4096])
def test_row_difference(spark, scratch, rows, fan):
    left = random_rows(1, 400)
    right = left[7:] + random_rows(2, 9) + [(None, None, None)] * 3
    found = row_difference(
        spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["k"],
        scratch=scratch, fan=fan,
    )
    assert rows(found) == expected(left, right)


def test_nulls_change_places(spark, scratch, rows):
    left, right = [("x", None, 1)], [("x", 1, None)]
    a, b = (spark.createDataFrame(r, "k string, v int, w int") for r in (left, right))
    found = row_difference(a, b, ["k"], scratch=scratch)
    assert rows(found) == expected(left, right)


def test_equal_tables_open_nothing(spark, scratch):
    left = spark.createDataFrame(random_rows(3, 300), SCHEMA)
    again = left.orderBy(F.rand(5)).withColumn("n", F.col("n").cast("long")).withColumn("more", F.lit(1))
    assert row_difference(left, again, ["k"], scratch=scratch).isEmpty()
    by = F.pmod(F.xxhash64("k"), F.lit(16))
    same = left.orderBy(F.rand(6))
    assert differing_ranges(left, same, by, left.columns).isEmpty()
    one_less = left.limit(299)
    assert differing_ranges(left, one_less, by, left.columns).count() == 1


def test_empty_tables(spark, scratch, rows):
    some = [("a", 1, 0.5), ("a", 1, 0.5)]
    full, empty = spark.createDataFrame(some, SCHEMA), spark.createDataFrame([], SCHEMA)
    assert row_difference(empty, empty, ["k"], scratch=scratch).isEmpty()
    assert rows(row_difference(full, empty, ["k"], scratch=scratch)) == [("a", 1, 0.5, 2, 0)]
    assert rows(row_difference(empty, full, ["k"], scratch=scratch)) == [("a", 1, 0.5, 0, 2)]
