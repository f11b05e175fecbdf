import json

from pyspark.sql import functions as F

from millrace.operators.quality import (
    ERROR_FLAG,
    ERROR_TEXT,
    Rule,
    allowed_values,
    apply_rules,
    castable_rules,
    error_histogram,
    flag_rows,
    invalid_rows,
    mark_duplicates,
    non_negative,
    parsable_date,
    quarantine_rows,
    reconcile,
    split_counts,
    valid_rows,
)
from millrace.spec import Column, TableSpec

PLAIN = TableSpec(
    "t", (Column("id", "int", nullable=False), Column("name", "str"), Column("value", "float"))
)
KEYED = TableSpec("t", PLAIN.columns, primary_key=("id",))


def frame(spark, *ids):
    return spark.createDataFrame([(i, "n", 1.0) for i in ids], "id long, name string, value double")


def test_all_valid(spark, scratch):
    flagged = flag_rows(frame(spark, 1, 2), PLAIN, scratch=scratch)
    assert tuple(split_counts(flagged).first()) == (2, 2, 0)
    assert valid_rows(flagged).columns == ["id", "name", "value"]


def test_null_in_a_required_column(spark, scratch):
    flagged = flag_rows(frame(spark, 1, None), PLAIN, scratch=scratch)
    bad = invalid_rows(flagged).collect()
    assert [r[ERROR_TEXT] for r in bad] == ["Column 'id' is required but null."]


def test_every_copy_of_a_key_is_invalid(spark, scratch):
    flagged = flag_rows(frame(spark, 1, 1, 2), KEYED, scratch=scratch)
    bad = invalid_rows(flagged).collect()
    assert [r["id"] for r in bad] == [1, 1]
    assert bad[0][ERROR_TEXT] == "Duplicate primary key on columns ['id']."


def test_messages_are_joined_in_order(spark, scratch, rows):
    flagged = flag_rows(frame(spark, None, None), KEYED, scratch=scratch)
    text = "Column 'id' is required but null.; Duplicate primary key on columns ['id']."
    assert [r[ERROR_TEXT] for r in flagged.collect()] == [text, text]
    assert rows(error_histogram(flagged)) == [
        ("Column 'id' is required but null.", 2),
        ("Duplicate primary key on columns ['id'].", 2),
    ]


def test_empty_frame(spark, scratch):
    flagged = flag_rows(frame(spark, 1).filter("false"), KEYED, scratch=scratch)
    assert tuple(split_counts(flagged).first()) == (0, 0, 0)


def test_required_with_default_is_not_an_error(spark, scratch):
    spec = TableSpec("t", (Column("id", "int", nullable=False, default=0),))
    flagged = flag_rows(spark.createDataFrame([(None,)], "id long"), spec, scratch=scratch)
    assert not flagged.first()[ERROR_FLAG]


def brute_duplicates(pairs):
    return sorted(((*p, pairs.count(p) > 1) for p in pairs), key=repr)


def test_duplicates_with_hot_keys_match_brute_force(spark, scratch, no_broadcast, rows):
    pairs = [(1, None)] * 40 + [(None, None)] * 30 + [(2, "a")] * 3 + [(i, "b") for i in range(50)]
    df = spark.createDataFrame(pairs, "a int, b string")
    for hot_rows in (2, 10, 1000):
        marked = mark_duplicates(df, ["a", "b"], scratch=scratch, hot_rows=hot_rows)
        assert rows(marked) == brute_duplicates(pairs)


def test_hot_keys_stay_out_of_the_shuffle(spark, scratch, no_broadcast):
    df = spark.createDataFrame([(1,)] * 40 + [(2,)] * 2, "a int")
    marked = mark_duplicates(df, ["a"], scratch=scratch, hot_rows=10)
    plan = marked._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan


def test_custom_rules(spark, rows):
    df = spark.createDataFrame(
        [("BUY", 1, "2024-01-31"), ("FEE", -1, "2024-01-32"), (None, None, None)],
        "kind string, qty int, day string",
    )
    rules = [
        allowed_values("kind", ["BUY"]),
        non_negative("qty"),
        parsable_date("day"),
        Rule("never", F.lit(False)),
    ]
    assert [r[ERROR_TEXT] for r in apply_rules(df, rules).collect()] == [
        "",
        "Column 'kind' has a value that is not allowed.; Column 'qty' is negative.; "
        "Column 'day' is not a date.",
        "",
    ]
    patterned = apply_rules(
        spark.createDataFrame([("31.01.2024",), ("2024-01-31",)], "day string"),
        [parsable_date("day", "dd.MM.yyyy")],
    )
    assert [r[ERROR_FLAG] for r in patterned.collect()] == [False, True]


def test_castable(spark):
    spec = TableSpec("t", (Column("n", "int"), Column("d", "date"), Column("s", "str")))
    df = spark.createDataFrame(
        [("1", "2024-01-01", 1), ("1.5", "soon", 2), (None, None, 3)], "n string, d string, s int"
    )
    flagged = apply_rules(df, castable_rules(df, spec))
    assert [r[ERROR_TEXT] for r in flagged.collect()] == [
        "",
        "Column 'n' is not a valid int.; Column 'd' is not a valid date.",
        "",
    ]


def test_quarantine(spark):
    df = spark.createDataFrame(
        [(1, None, True, "bad"), (2, "x", True, "")],
        f"id int, name string, {ERROR_FLAG} boolean, {ERROR_TEXT} string",
    )
    out = quarantine_rows(df, run_id="r", stage="validation", source_id="s", table_name="t").collect()
    assert json.loads(out[0]["raw_row_json"]) == {"id": 1, "name": None}
    assert [r["error_message"] for r in out] == ["bad", "Row failed validation."]
    assert out[0]["persisted_at"] is not None
    typed = spark.sql("SELECT 1.50BD AS d, TIMESTAMP_NTZ'2024-01-02 03:04:05' AS t, DATE'2024-01-02' AS y, 2.0D AS x")
    row = quarantine_rows(typed, run_id="r", stage="v", source_id="s", table_name="t").first()
    assert json.loads(row["raw_row_json"]) == {
        "d": "1.50", "t": "2024-01-02 03:04:05", "y": "2024-01-02", "x": 2.0
    }
    bare = spark.createDataFrame([(1,)], "id int")
    row = quarantine_rows(
        bare, run_id="r", stage="v", source_id="s", table_name="t", default_message="why"
    ).first()
    assert row["error_message"] == "why"


def test_reconcile(spark, rows):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 1.0), (3, 1.0)], "k int, v double")
    b = spark.createDataFrame([(1, 5.0), (2, 1.0), (4, 1.0)], "k int, v double")
    found = reconcile(a, b, ["k"], ["v"])
    assert sorted(r["k"] for r in found.collect()) == [1, 3, 4]
