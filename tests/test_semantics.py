import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.documents import (
    chunk_documents,
    chunk_texts,
    chunk_totals,
    project_documents,
    with_row_index,
)
from millrace.operators.index import (
    cascade_vectors,
    get_chunk,
    grid_shape,
    index_rows,
    merge_index,
    nearest_vectors,
    obsolete_chunks,
    query_chunks,
    sync_index,
    vector_sources,
)
from millrace.spec import DocumentSpec

SPEC = DocumentSpec(
    "test_docs",
    "test_table",
    "Name is {name}, value is {value}.",
    title_template="Doc: {name}",
    metadata_fields=("category",),
    tag_fields=("category",),
    chunk_size=15,
    chunk_overlap=5,
)


def things(spark):
    return spark.createDataFrame([("A", 10, "X"), ("B", 20, "Y")], "name string, value int, category string")


def test_projection(spark):
    documents, failures = project_documents(things(spark), SPEC)
    first = documents.orderBy("title").first()
    assert (first["title"], first["body"]) == ("Doc: A", "Name is A, value is 10.")
    assert json.loads(first["metadata"]) == {"category": "X"}
    assert (first["tags"], first["semantic_id"], first["source_table"]) == (["X"], "test_docs", "test_table")
    assert len(first["doc_id"]) == 32 and first["source_pk"] is None
    assert failures.count() == 0


def test_missing_template_column(spark):
    documents, _ = project_documents(things(spark).drop("value"), SPEC)
    assert {r["body"] for r in documents.collect()} == {"Name is A, value is .", "Name is B, value is ."}


def test_unknown_id_strategy_fails_every_row(spark):
    spec = DocumentSpec("s", "t", "{name}", id_strategy="unsupported_strategy")
    documents, failures = project_documents(things(spark), spec)
    assert documents.count() == 0
    assert [r["reason"] for r in failures.collect()] == [
        "Unsupported document_id_strategy: unsupported_strategy"
    ] * 2


def test_metadata_and_tags(spark):
    df = spark.createDataFrame([(None, 1.5)], "a string, b double")
    spec = DocumentSpec(
        "s", "t", "", metadata_fields=("a", "gone", "b"), tag_fields=("a", "b", "gone"),
        extra_metadata={"b": "over", "n": {"x": [1]}},
    )
    row = project_documents(df, spec)[0].first()
    assert json.loads(row["metadata"]) == {"a": None, "gone": None, "b": "over", "n": {"x": [1]}}
    assert row["tags"] == ["1.5"]


def test_content_ids(spark):
    def ids(df, **more):
        spec = DocumentSpec("s", "t", "", **more)
        return {r["doc_id"] for r in project_documents(df, spec)[0].collect()}

    df = things(spark)
    assert ids(df) == ids(df.select("value", "category", "name"))
    assert ids(df).isdisjoint(ids(df.withColumn("_file_hash", F.lit("new"))))
    stamped = df.withColumn("_file_hash", F.lit("new"))
    assert ids(df, id_columns=("name",)) == ids(stamped, id_columns=("name",))


def test_row_index(spark, scratch):
    data = [(i % 7, f"v{i}") for i in range(200)]
    df = spark.createDataFrame(data, "k int, v string").repartition(5)
    got = with_row_index(df, ["k", "v"], scratch=scratch).collect()
    assert [(r["k"], r["v"]) for r in sorted(got, key=lambda r: r["_row_index"])] == sorted(data)
    assert sorted(r["_row_index"] for r in got) == list(range(200))
    same = spark.range(100).select(F.lit(1).alias("k"))
    numbered = with_row_index(same, ["k"], scratch=scratch)
    assert sorted(r["_row_index"] for r in numbered.collect()) == list(range(100))
    with pytest.raises(ValueError):
        with_row_index(df, [], scratch=scratch)


def model_chunks(text, size, overlap):
    step = size - overlap
    return [text[p : p + size] for p in range(0, len(text), step)] or [""]


@pytest.mark.parametrize(("size", "overlap"), [(15, 5), (10, 9), (1, 0), (500, 50), (7, 0)])
def test_chunks_match_a_model(spark, size, overlap):
    rng = random.Random(size)
    letters = "ab \n\r\tñ漢😀𝄞."
    texts = ["", "x", "ab" * 300] + [
        "".join(rng.choice(letters) for _ in range(rng.randint(0, 90))) for _ in range(40)
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for text, chunks in df.select("t", chunk_texts(F.col("t"), size, overlap)).collect():
        assert chunks == model_chunks(text, size, overlap)


def test_chunk_rows(spark):
    long_doc = spark.createDataFrame([("LongDoc", 100, "Test")], "name string, value int, category string")
    documents, _ = project_documents(long_doc, SPEC)
    chunks = chunk_documents(documents, size=15, overlap=5).orderBy("chunk_index").collect()
    doc_id = documents.first()["doc_id"]
    assert [c["chunk_text"] for c in chunks] == ["Name is LongDoc", "ngDoc, value is", "ue is 100."]
    assert [c["chunk_id"] for c in chunks] == [f"{doc_id}_{i}" for i in range(3)]
    assert [c["char_count"] for c in chunks] == [15, 15, 10]
    totals = chunk_totals(documents, chunk_documents(documents, size=15, overlap=5)).first()
    assert tuple(totals) == ("test_docs", 1, 3, 40)
    null_body = documents.withColumn("body", F.lit(None).cast("string"))
    assert [c["chunk_text"] for c in chunk_documents(null_body).collect()] == [""]


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (5, -1), (5, 5)])
def test_chunk_bounds(size, overlap):
    with pytest.raises(ValueError):
        DocumentSpec("s", "t", "", chunk_size=size, chunk_overlap=overlap)


def index_of(spark, run_id, *texts, semantic_id="s"):
    docs = spark.createDataFrame(
        [(f"{semantic_id}{i}", "t", str(i), semantic_id, None, x, "{}", ["g"]) for i, x in enumerate(texts)],
        "doc_id string, source_table string, source_pk string, semantic_id string, title string, "
        "body string, metadata string, tags array<string>",
    )
    return index_rows(chunk_documents(docs, size=4, overlap=1), run_id)


def content(df, rows):
    return rows(df.select("chunk_id", "chunk_text", "run_id"))


def test_index_merge_and_sync(spark, rows):
    old = index_of(spark, "r1", "abcdef", "xyz").unionByName(index_of(spark, "r1", "other", semantic_id="o"))
    new = index_of(spark, "r2", "abcd", "new")
    others = [("o0_0", "othe", "r1"), ("o0_1", "er", "r1")]
    assert content(merge_index(old, new), rows) == [*others, ("s0_0", "abcd", "r2"), ("s0_1", "d", "r2"), ("s1_0", "new", "r2")]
    kept = merge_index(old, new, replace_existing=False)
    assert content(kept, rows) == [*others, ("s0_0", "abcd", "r1"), ("s0_1", "def", "r1"), ("s1_0", "xyz", "r1")]
    shorter = index_of(spark, "r2", "abc")
    assert content(sync_index(old, shorter, "s"), rows) == [*others, ("s0_0", "abc", "r2")]
    kept = sync_index(old, shorter, "s", replace_existing=False)
    assert content(kept, rows) == [*others, ("s0_0", "abcd", "r1")]
    assert rows(obsolete_chunks(old, shorter, "s").select("chunk_id")) == [("s0_1",), ("s1_0",)]


def test_index_queries(spark):
    index = index_of(spark, "run123", "abcdef", "xyz")
    assert [r["chunk_id"] for r in query_chunks(index, semantic_id="s").collect()] == ["s0_0", "s0_1", "s1_0"]
    assert query_chunks(index, limit=2).count() == 2
    assert query_chunks(index, run_id="other").count() == 0
    assert query_chunks(index, source_table="t", run_id="run123", limit=None).count() == 3
    single = get_chunk(index, "s1_0").first()
    assert (single["chunk_text"], json.loads(single["tags_json"])) == ("xyz", ["g"])
    assert get_chunk(index, "none").first() is None


def test_vectors(spark, scratch, no_broadcast, rows):
    index = index_of(spark, "r", "abc")
    vectors = spark.createDataFrame([("s0_0", 1), ("gone", 2)], "chunk_id string, vec_id int")
    assert rows(cascade_vectors(vectors, index)) == [("s0_0", 1)]
    refs = spark.createDataFrame([(1, i) for i in range(20)] + [(2, 50), (3, 60)], "source_row_id int, vec_id int")
    source = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    joined = vector_sources(refs, source, source_id="id", scratch=scratch, hot_rows=5)
    assert rows(joined.select("source_row_id", "vec_id", "name")) == sorted(
        [(1, i, "a") for i in range(20)] + [(2, 50, "b")], key=repr
    )


@pytest.mark.parametrize("resident, block", [(1000, 2048), (0, 2048), (0, 1)])
def test_nearest_vectors_match_brute_force(spark, scratch, rows, monkeypatch, resident, block):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(300, 8))
    data[17] = data[4]  # a tie
    data[9] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    odd = [(999, None), (998, [None] * 8), (997, [float("inf")] * 8)]
    df = df.unionByName(spark.createDataFrame(odd, df.schema)).repartition(6)
    asked = [("a", data[4].tolist()), ("b", rng.normal(size=8).tolist()), ("c", [0.0] * 8)]
    queries = spark.createDataFrame([*asked, ("d", None)], "query_id string, embedding array<double>")
    expected = []
    for qid, q in asked:
        q = np.array(q)
        lengths = np.linalg.norm(data, axis=1) * np.linalg.norm(q)
        score = data @ q / np.where(lengths == 0, 1, lengths)
        order = sorted(range(300), key=lambda i: (-round(score[i], 12), i))[:5]
        expected += [(qid, i, r + 1) for r, i in enumerate(order)]

    def nearest(k):
        found = nearest_vectors(
            df, queries, k, scratch=scratch, resident_floats=resident, block_queries=block
        )
        return found.select("query_id", "vec_id", "rank")

    assert rows(nearest(5)) == sorted(expected, key=repr)
    assert nearest(1000).count() == 900


def test_nearest_vectors_of_nothing(spark, scratch):
    schema = "query_id long, embedding array<float>"
    none = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, [1.0, 0.0])], schema)
    vectors = some.withColumnRenamed("query_id", "vec_id")
    for resident in (0, 1000):
        for v, q in ((vectors, none), (vectors.limit(0), some)):
            assert nearest_vectors(v, q, 3, scratch=scratch, resident_floats=resident).count() == 0


def test_a_block_meets_its_vectors_in_one_task(spark, scratch):
    """The plan of many queries: no driver, no broadcast, one exchange before the heaps."""
    vectors = spark.range(400).selectExpr("id AS vec_id", "array(cos(id), sin(id)) AS embedding")
    queries = vectors.selectExpr("vec_id AS query_id", "embedding")
    found = nearest_vectors(vectors, queries, 1, scratch=scratch, resident_floats=0, block_queries=50)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression" in plan
    assert found.filter("query_id = vec_id").count() == 400


def test_the_grid_moves_vectors_a_bounded_number_of_times():
    """Small blocks share a task, so what is moved grows with the vectors, not their square."""
    moved = []
    for vectors in (100_000, 1_000_000):
        groups, parts = grid_shape(200, vectors // 10, vectors, 64, 3, 64)
        assert groups * parts >= 200
        moved.append(groups * vectors + parts * vectors // 10)
    assert moved[1] <= 10 * moved[0] * 1.01
    assert moved[1] <= 20 * 1_000_000
    # What a task holds stays within its limit: one block of many winners, or many of few.
    for n, k in ((10**7, 3), (10**5, 100)):
        groups, _ = grid_shape(200, n, n, 64, k, 64)
        assert n / groups * (64 + 8 * k) <= 4_100_000
    assert grid_shape(4, 10, 400, 2, 1, 50) == (1, 4)
