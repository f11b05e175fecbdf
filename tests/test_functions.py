import datetime as dt
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.cleaning import guarded_ratio, lossless_cast, safe_cast, text_cast
from millrace.functions.keys import (
    concat_key,
    hash_all_columns,
    key_bucket,
    prefixed_id,
    record_hash,
    with_record_hash,
)
from millrace.functions.template import plain_parts, render
from millrace.functions.text import display_text, double_text


def test_double_text_is_that_of_python(spark):
    rng = random.Random(3)
    values = [0.0, -0.0, 1e7, 123456789.125, 1e-4, 9.99e-4, 1.5e-7, 1e22, 1e16, -1e7, 0.1 + 0.2]
    values += [float("inf"), float("-inf"), float("nan")]
    values += [round(rng.uniform(-1e5, 1e9), 2) for _ in range(2000)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-6, 14) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for value, text in df.select("x", double_text(F.col("x"))).collect():
        assert text == str(value)


def test_display_text(spark):
    df = spark.createDataFrame(
        [(True, dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 500000))],
        "b boolean, t timestamp_ntz, u timestamp_ntz",
    )
    shown = df.select(*[display_text(F.col(f.name), f.dataType) for f in df.schema]).first()
    assert tuple(shown) == ("True", "2024-01-02 03:04:05", "2024-01-02 03:04:05.500000")


def test_record_hash_covers_nulls_and_order(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "y", None)], "a int, b string, c string")
    got = [r[0] for r in df.select(record_hash(df, ["c", "a", "b", "absent"])).collect()]
    assert got == [hashlib.sha256(t.encode()).hexdigest() for t in ("x||1||", "||2||y")]
    short = df.select(record_hash(df, ["a"], length=32)).first()[0]
    assert short == hashlib.sha256(b"1").hexdigest()[:32]


def test_record_hash_without_any_column_changes_nothing(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert with_record_hash(df, ["b"]).columns == ["a"]


def test_hash_all_columns_leaves_out_system_columns(spark):
    df = spark.createDataFrame([(1, "f", "x")], "a int, _file_hash string, b string")
    digest = hash_all_columns(df).first()["_record_hash"]
    assert digest == hashlib.sha256(b"1|x").hexdigest()


def test_keys(spark):
    df = spark.createDataFrame([("a", None, 3)], "x string, y string, z int")
    assert concat_key(df, ["x", "y", "z"], "k").first()["k"] == "a__3"
    assert concat_key(df, ["x", "z"], "k", separator="/").first()["k"] == "a/3"
    assert prefixed_id(df, ["x", "y", "z"], "k").first()["k"] == "INV-a--3"


def test_rows_without_key_are_spread_over_buckets(spark):
    df = spark.range(1000).select(F.lit(None).cast("long").alias("k"), F.col("id").alias("v"))
    buckets = df.select(key_bucket(df, ["k"], 8).alias("b")).distinct().count()
    assert buckets == 8


def test_safe_cast_and_ratio(spark):
    df = spark.createDataFrame(
        [("12", 4.0, 2.0), ("2026.0", 4.0, 0.0), (None, 4.0, None)], "t string, p double, w double"
    )
    got = df.select(
        safe_cast(F.col("t"), T.IntegerType(), 1900, source=T.StringType()), guarded_ratio(F.col("p"), F.col("w"))
    ).collect()
    assert [tuple(r) for r in got] == [(12, 2.0), (1900, 0.0), (1900, 0.0)]


@pytest.mark.parametrize(
    "target", [T.IntegerType(), T.LongType(), T.DecimalType(20, 4), T.DateType(), T.TimestampNTZType()]
)
def test_text_cast_is_try_cast(spark, target):
    texts = ["1", " 12 ", "+5", "-7", "\t8\n", "1.5", ".5", "5.", "1e3", "-1E-2", "x", "", " ", "1 2"]
    texts += ["2024", "2024-2", "2024-02-30", "2024-02-29", " 2024-02-29 ", "2024-1-1T10:00:00"]
    texts += ["2024-01-01 10:11:12.5", "12345-01-01", "99999999999", "0x10", "--1", "1d", "today"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    ours, plain = text_cast(F.col("t"), target), F.col("t").try_cast(target)
    for text, ours, plain in df.select("t", ours.cast("string"), plain.cast("string")).collect():
        assert ours == plain, text


@pytest.mark.parametrize(
    ("value", "source", "target", "expected"),
    [
        ("12", T.StringType(), T.LongType(), 12),
        ("2026.0", T.StringType(), T.LongType(), 2026),
        ("2026.5", T.StringType(), T.LongType(), None),
        ("word", T.StringType(), T.LongType(), None),
        (2.0, T.DoubleType(), T.LongType(), 2),
        (2.5, T.DoubleType(), T.LongType(), None),
        (1.5e7, T.DoubleType(), T.StringType(), "15000000.0"),
        ("2024-02-29", T.StringType(), T.DateType(), dt.date(2024, 2, 29)),
        ("2023-02-29", T.StringType(), T.DateType(), None),
        (True, T.BooleanType(), T.LongType(), 1),
    ],
)
def test_lossless_cast(spark, value, source, target, expected):
    df = spark.createDataFrame([(value,)], T.StructType([T.StructField("x", source)]))
    assert df.select(lossless_cast(F.col("x"), source, target)).first()[0] == expected


def test_template_parts():
    assert plain_parts("{a} {{x}} {b}") is not None
    for template in ("{a:.2f}", "{a!r}", "{a.b}", "{a[0]}", "{0}", "{}"):
        assert plain_parts(template) is None


@pytest.mark.parametrize(
    ("template", "expected"),
    [
        ("Name is {name}, value is {value}.", "Name is A, value is 10."),
        ("Name is {name}, value is {gone}.", "Name is A, value is ."),
        ("{empty} {{kept}}", "None {kept}"),
        ("no field", "no field"),
        ("", ""),
        ("{value:05d}|{name!r}|{gone}", "00010|'A'|"),
        ("{price}", "12345678.5"),
        ("{name}😀{name}", "A😀A"),
    ],
)
def test_render(spark, template, expected):
    df = spark.createDataFrame(
        [("A", 10, None, 12345678.5)], "name string, value long, empty string, price double"
    )
    text, error = render(df, template)
    assert tuple(df.select(text, error).first()) == (expected, None)


def test_render_reports_rows_it_cannot_format(spark):
    df = spark.createDataFrame([(1.5,), (None,)], "x double")
    text, error = render(df, "{x:.2f}")
    got = df.select(text, error).collect()
    assert tuple(got[0]) == ("1.50", None)
    assert got[1][0] is None and "NoneType" in got[1][1]
    _, positional = render(df, "{0}")
    assert all(r[0] for r in df.select(positional).collect())
