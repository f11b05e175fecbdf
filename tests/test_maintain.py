"""Maintained aggregates against a recompute, after random changes."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.maintain import GroupStates
from millrace.plans.jobs import DerivedTable, maintained_states
from millrace.sources.tables import TableStore
from millrace.spec import Column, TableSpec

BASE = TableSpec(
    "base",
    (Column("id", "int", key=True), Column("g", "str"), Column("x", "int")),
    kind="derived", depends_on=("none",), load_mode="upsert", buckets=16,
)
STATES = GroupStates(("g",), count="n", sums={"total": "x"}, means={"mean": "x"})
TABLE = DerivedTable(
    TableSpec("stats", (Column("g", key=True), Column("n", "int")), kind="derived", depends_on=("base",)),
    maintained=STATES,
)


def plain(df):
    return df.groupBy("g").agg(
        F.count("*").alias("n"), F.sum("x").alias("total"), F.avg("x").cast("int").alias("mean")
    )


def test_states_follow_random_upserts(spark, tmp_path, rows, monkeypatch):
    store = TableStore(spark, str(tmp_path / "store"))
    rng = random.Random(5)

    def batch(n, ids):
        values = [
            (i, rng.choice(["a", "b", None, "c"]), rng.choice([None, 7, -3, 10**6]))
            for i in rng.sample(range(ids), n)
        ]
        return spark.createDataFrame(values, "id long, g string, x long")

    read = []
    changes = TableStore.changes

    def watched(self, name, since):
        found = changes(self, name, since)
        read.append(None if found is None else len(found.inputFiles()))
        return found

    monkeypatch.setattr(TableStore, "changes", watched)
    store.write(BASE, batch(200, 300))
    for size in (0, 1, 2, 1):
        if size:
            store.write(BASE, batch(size, 300))
        states = maintained_states(store, TABLE)
        assert rows(STATES.finish(states)) == rows(plain(store.read("base")))
    # The first time there is nothing to start from; then one folder comes and one
    # goes for each bucket that a batch touches, out of sixteen.
    assert len(read) == 3 and all(n is not None and n <= 4 for n in read)
    # Two batches at once, then all buckets: more to read than the table, so anew.
    for _ in range(2):
        store.write(BASE, batch(1, 300))
    assert rows(STATES.finish(maintained_states(store, TABLE))) == rows(plain(store.read("base")))
    store.write(BASE, batch(300, 300))
    assert rows(STATES.finish(maintained_states(store, TABLE))) == rows(plain(store.read("base")))
    assert read[-1] is None and read[-2] is not None


def test_emptied_groups_go(spark, rows):
    before = spark.createDataFrame([("a", 1), ("a", None), (None, 5)], "g string, x int")
    gone = spark.createDataFrame([(None, 5, -1), ("a", 1, -1), ("b", 2, 1)], "g string, x int, s int")
    states = STATES.merged(STATES.states(before), STATES.states(gone, sign="s"))
    assert rows(STATES.finish(states)) == [("a", 1, None, None), ("b", 1, 2, 2)]


def test_lost_versions_are_made_anew(spark, tmp_path, rows):
    store = TableStore(spark, str(tmp_path / "store"))
    schema = "id long, g string, x long"
    store.write(BASE, spark.createDataFrame([(i, "a", i) for i in range(50)], schema))
    maintained_states(store, TABLE)
    store.write(BASE, spark.createDataFrame([(1, "b", 9)], schema))
    store.remove_dead("base")
    assert store.changes("base", 1) is None and store.changes("base", 0) is None
    assert rows(STATES.finish(maintained_states(store, TABLE))) == rows(plain(store.read("base")))
    assert store.changes("base", store.version("base")).count() == 0


def test_inexact_sums_are_refused(spark):
    with pytest.raises(TypeError):
        GroupStates(("g",), sums={"t": "x"}).states(spark.createDataFrame([("a", 0.5)], "g string, x double"))
    with pytest.raises(ValueError):
        DerivedTable(TABLE.spec)
