import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.derive import (
    Transform,
    group_stats,
    group_sums,
    ordered_distinct,
    run_chain,
    share_of_total,
)
from millrace.operators.shape import (
    clean,
    dedupe,
    fill_missing,
    fill_required_defaults,
    normalise_transactions,
    relaxed_union,
    supertype,
    target_projection,
    where_equal,
    with_provenance,
)
from millrace.spec import Column, ForeignKey, FrameContract, TableSpec, gate_errors, schema_gate


def test_provenance_defaults_to_unknown(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert tuple(with_provenance(df).first()) == (1, "unknown", "unknown")
    assert with_provenance(df, file_hash="h", source_file="/x").first()["_source_file"] == "/x"


@pytest.mark.parametrize(
    ("left", "right", "expected"),
    [
        (T.IntegerType(), T.LongType(), T.LongType()),
        (T.LongType(), T.DoubleType(), T.DoubleType()),
        (T.LongType(), T.StringType(), T.StringType()),
        (T.BooleanType(), T.LongType(), T.LongType()),
        (T.DecimalType(10, 2), T.DecimalType(12, 4), T.DecimalType(12, 4)),
        (T.DateType(), T.TimestampNTZType(), T.TimestampNTZType()),
        (T.DateType(), T.LongType(), T.StringType()),
        (T.NullType(), T.DateType(), T.DateType()),
    ],
)
def test_supertype(left, right, expected):
    assert supertype(left, right) == expected
    assert supertype(right, left) == expected


def test_relaxed_union(spark, rows):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([("word", 2.5)], "k string, w double")
    assert rows(relaxed_union([a, None, b])) == [("1", "x", None), ("word", None, 2.5)]
    assert relaxed_union([a]) is a
    assert relaxed_union([]) is None


SPEC = TableSpec(
    "t",
    (
        Column("id", "int", key=True),
        Column("name", "str"),
        Column("kind", "str", nullable=False, default="plain"),
        Column("flag", "bool"),
        Column("amount", "decimal", precision=12, scale=0),
    ),
    kind="derived",
    depends_on=("x",),
)


def test_fill(spark):
    df = spark.createDataFrame([(1,)], "id long")
    row = fill_missing(df, SPEC).first()
    assert row["name"] is None and row["kind"] == "plain" and row["amount"] is None
    nulls = spark.createDataFrame([(1, None, None)], "id long, name string, kind string")
    row = fill_required_defaults(nulls, SPEC).first()
    assert row["name"] is None and row["kind"] == "plain"


def test_target_projection(spark):
    df = spark.createDataFrame(
        [("2026.0", "n", True, "7", "extra")],
        "id string, name string, flag boolean, amount string, more string",
    )
    out = target_projection(df, SPEC)
    assert out.columns == ["id", "name", "kind", "flag", "amount"]
    assert tuple(out.first()) == (2026, "n", None, 1, 7)
    assert out.schema == SPEC.schema()


def test_dedupe(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (1, None)], "k int, v string")
    assert rows(dedupe(df, ["k", "v", "absent"])) == [(1, "a"), (1, None)]
    assert dedupe(df, ["k"]).count() == 1


def test_clean(spark, rows):
    df = spark.createDataFrame([("2026.0", None), ("42", "tech")], "year string, industry string")
    cleaned = clean(df, casts={"year": ("int", 1900)}, uppers={"industry": "Unknown"})
    assert rows(cleaned) == [(1900, "UNKNOWN"), (42, "TECH")]


def test_normalise_transactions(spark, rows):
    df = spark.createDataFrame(
        [("abc", " acc ", "BUY", 1.0), ("d", "a", "BUY", 0.0), ("e", "a", "FEE", 1.0)],
        "symbol string, account_name string, transaction_type string, quantity double",
    )
    assert rows(normalise_transactions(df)) == [("ABC", "acc", "BUY", 1.0)]


def test_where_equal(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "k int, v string")
    assert where_equal(df, v="a", k=None).count() == 2
    assert where_equal(df, v="a", k=2).count() == 1


def test_schema_gate(spark):
    def gate(columns):
        return schema_gate(spark.createDataFrame([], columns), SPEC)

    assert [i.severity for i in gate("id int, name string, kind string, flag boolean")] == ["warning"]
    assert len(gate_errors(gate("name string"))) == 2  # required and part of the key
    assert gate_errors(schema_gate(None, SPEC))[0].column == "__frame__"
    optional = TableSpec("t", (Column("id", "int", nullable=False), Column("v", "str")))
    missing = schema_gate(spark.createDataFrame([], "v string"), optional)
    assert [i.column for i in gate_errors(missing)] == ["id"]


def test_spec_checks():
    with pytest.raises(ValueError, match="twice"):
        TableSpec("t", (Column("a"), Column(" A ")))
    with pytest.raises(ValueError, match="system columns"):
        TableSpec("t", (Column("_file_hash"),))
    with pytest.raises(ValueError, match="Key column"):
        TableSpec("t", (Column("a"),), primary_key=("b",))
    with pytest.raises(ValueError, match="unequal"):
        TableSpec("t", (Column("a"),), foreign_keys=(ForeignKey(("a",), "x", ("b", "c")),))
    with pytest.raises(ValueError, match="depends"):
        TableSpec("t", (Column("a"),), kind="derived")
    spec = TableSpec("t", (Column("a"), Column("b")), primary_key=("b",), record_hash=True)
    assert spec.key == ["b"] and not spec.nullable(spec.columns[1])
    assert spec.schema().names == ["a", "b", "_file_hash", "_source_file", "_record_hash"]


def test_group_stats_truncates_means(spark, rows):
    df = spark.createDataFrame([("a", 1, -3), ("a", 2, -4), ("b", 5, 7)], "k string, v int, y int")
    stats = group_stats(df, "k", count="n", total=("v", "total"), mean=("y", "avg_y"))
    assert rows(stats) == [("a", 2, 3, -3), ("b", 1, 5, 7)]


def test_share_of_total(spark, rows):
    df = spark.createDataFrame([("x", "a", 1), ("y", "a", 3), ("x", "b", 0)], "c string, i string, v int")
    parts = group_sums(df, ["c", "i"], v="v")
    totals = group_sums(df, ["i"], t="v").filter("i != 'b'")
    out = share_of_total(parts, totals, "i", part="v", whole="t", whole_as="whole", share="share")
    assert rows(out.select("c", "i", "whole", "share")) == [
        ("x", "a", 4, 0.25),
        ("x", "b", None, 0.0),
        ("y", "a", 4, 0.75),
    ]


def test_ordered_distinct(spark):
    refs = spark.createDataFrame([("b", 0), ("a", 1), ("b", 2), ("c", 3)], "ref string, pos int")
    assert [r["ref"] for r in ordered_distinct(refs, "ref", "pos").collect()] == ["b", "a", "c"]


def add_column(df, name="n", value=1):
    return df.withColumn(name, F.lit(value))


def broken(df):
    return df.select("no_such_column")


def test_chain_order_and_failure_policies(spark):
    df = spark.createDataFrame([(1,)], "a int")
    chain = [
        Transform(add_column, params={"name": "y"}, order=2),
        Transform(add_column, name="first", params={"name": "x"}, order=1),
        Transform(add_column, params={"name": "off"}, enabled=False),
        Transform(broken, order=1, on_failure="warn_only"),
    ]
    applied = []
    assert run_chain(df, chain, applied=applied).columns == ["a", "x", "y"]
    assert applied == ["first", "add_column"]
    for policy in ("fail_run", "route_to_dlq"):
        with pytest.raises(Exception, match="no_such_column"):
            run_chain(df, [Transform(broken, on_failure=policy)])
    with pytest.raises(ValueError, match="policy"):
        Transform(broken, on_failure="shrug")


def test_contracts(spark):
    df = spark.createDataFrame([(1,)], "a int")
    needs_b = FrameContract(requires=("b",))
    with pytest.raises(ValueError, match=r"lacks columns that the step needs: \['b'\]"):
        run_chain(df, [Transform(add_column, contract=needs_b)])
    keeps = FrameContract(mutation="preserves_schema")
    with pytest.raises(ValueError, match="preserved"):
        run_chain(df, [Transform(add_column, contract=keeps)])
    typed = FrameContract(input_schema=T.StructType([T.StructField("a", T.StringType())]))
    with pytest.raises(ValueError, match="of other types"):
        run_chain(df, [Transform(add_column, contract=typed)])
    promised = FrameContract(provides=("zzz",))
    with pytest.raises(ValueError, match="promises"):
        run_chain(df, [Transform(add_column, contract=promised)])
    adds = FrameContract(requires=("A",), provides=("n",), mutation="adds_columns")
    assert run_chain(df, [Transform(add_column, contract=adds)]).columns == ["a", "n"]
