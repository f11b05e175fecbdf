"""The pipeline, stage by stage, on the small tables."""

import os

import pytest

import corpus_pipeline
from llm_cases import EMPTY_SCHEMA
from millrace.llm.bag_minhash import near_duplicates

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def test_stages(spark, scratch):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        after = scratch.stage(stage(spark, docs, SF_DIR), name)
        seen.append(after.count())
        if name != "packing":
            assert after.columns == columns
            assert after.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
        if name == "line_dedup":
            assert after.count() == docs.count()
        if name == "near_dedup":
            classes = near_duplicates(docs, scratch=scratch)
            assert after.count() == classes.select("class_id").distinct().count()
            assert near_duplicates(after, scratch=scratch).filter("not kept").count() == 0
        docs = after
    pieces = docs.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert all(0 < r[1] <= 2048 for r in pieces)


def test_boilerplate_of_most_of_a_text_goes(spark):
    """Only texts that near dedup can take as copies stay whole."""
    shared = " ".join(f"p{i}" for i in range(60))
    own = {i: " ".join(f"own{i}x{j}" for j in range(n)) for i, n in enumerate([18, 9, 1, 0] * 5)}
    texts = {i: shared + ("\n" + text if text else "") for i, text in own.items()}
    rows = [(i, text, "en", f"s{i}", len(text)) for i, text in texts.items()]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long"
    )
    got = {r.doc_id: r for r in corpus_pipeline.drop_boilerplate(spark, docs, SF_DIR).collect()}
    for i, text in texts.items():
        # Between half and eight ninths of the characters are shared in the first two kinds.
        share = len(shared) / (len(shared) + len(own[i]))
        assert got[i].text == (own[i] if i % 4 < 2 else text)
        assert (0.5 < share < 8 / 9) == (i % 4 < 2)
        assert got[i].n_chars == len(got[i].text)


def test_nothing(spark):
    docs = spark.createDataFrame([], EMPTY_SCHEMA).drop("kept")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    assert docs.count() == 0
