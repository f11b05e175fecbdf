"""An index in buckets of documents, of which only the changed ones are written."""

import os

import pytest

from millrace.operators import audit
from millrace.plans import jobs
from millrace.plans.jobs import INDEX_DIGESTS, INDEX_TABLE, load_index
from millrace.spec import DocumentSpec

SPEC = DocumentSpec(
    "docs", "source", "{name} has {size}", source_pk="id", chunk_size=6, chunk_overlap=2, index_buckets=8
)


def bytes_of(store, folders):
    base = f"{store.root}/{INDEX_TABLE}/data"
    return sum(
        os.path.getsize(f"{base}/{f}/{name}") for f in folders for name in os.listdir(f"{base}/{f}")
    )


@pytest.fixture
def indexed(spark, store, scratch):
    def go(run_id, rows, spec=SPEC, **options):
        df = spark.createDataFrame(rows, "id string, name string, size int")
        store.rewrite("source", df)
        before = set(store.partition_folders(INDEX_TABLE, spec.semantic_id)) if store.exists(INDEX_TABLE) else set()
        log = audit.LineageLog(run_id)
        result = load_index(store, spec, run_id=run_id, scratch=scratch, lineage=log, **options)
        after = set(store.partition_folders(INDEX_TABLE, spec.semantic_id))
        return result, after - before, before - after

    return go


def chunks(store):
    found = store.read(INDEX_TABLE).orderBy("source_pk", "chunk_index").collect()
    return [(r.source_pk, r.chunk_index, r.chunk_text) for r in found]


def expected(rows):
    out = []
    for i, name, size in sorted(rows):
        body = f"{name} has {size}"
        out += [(i, n, body[at : at + 6]) for n, at in enumerate(range(0, len(body), 4))]
    return out


def test_only_changed_buckets_are_written(store, indexed):
    rows = [(f"k{i}", f"name {i}", i) for i in range(200)]
    result, came, _ = indexed("r1", rows)
    assert len(came) == 8 and result.documents == 200 and chunks(store) == expected(rows)
    whole = bytes_of(store, came)

    # One changed row: one bucket goes, one comes.
    rows[17] = ("k17", "other", 5)
    result, came, gone = indexed("r2", rows)
    assert len(came) == len(gone) == 1 and bytes_of(store, came) < whole / 4
    assert result.error is None and result.documents == 200 and chunks(store) == expected(rows)
    runs = {r.run_id for r in store.read(INDEX_TABLE).filter("source_pk = 'k17'").collect()}
    assert runs == {"r2"}

    # Nothing changed, whatever the order; then a row less and a row more.
    assert indexed("r3", rows[::-1])[1:] == (set(), set())
    rows = [*rows[1:], ("new", "new one", 1)]
    _, came, gone = indexed("r4", rows)
    assert 1 <= len(came) <= 2 and len(gone) == len(came) and chunks(store) == expected(rows)

    # Other windows, another number of buckets: all is written.
    _, came, gone = indexed("r5", rows, DocumentSpec(**{**SPEC.__dict__, "index_buckets": 4}))
    assert len(came) == 4 and len(gone) == 8 and chunks(store) == expected(rows)


def test_emptied_buckets_go(store, indexed):
    rows = [(f"k{i}", "n", i) for i in range(40)]
    indexed("r1", rows)
    result, came, gone = indexed("r2", rows[:1])
    assert len(gone) >= 7 and chunks(store) == expected(rows[:1])
    result, came, gone = indexed("r3", [])
    assert result.error and not came and not gone
    result, _, gone = indexed("r4", [], allow_empty=True)
    assert result.error is None and len(gone) == 1 and chunks(store) == []


def test_lost_digests_and_other_writers(store, indexed, spark, scratch):
    rows = [(f"k{i}", "n", i) for i in range(40)]
    # Stored without buckets first: the one folder goes when buckets come.
    indexed("r1", rows, DocumentSpec(**{**SPEC.__dict__, "index_buckets": None}))
    _, came, gone = indexed("r2", rows)
    assert len(gone) == 1 and len(came) == 8 and chunks(store) == expected(rows)
    # A lost run wrote no digests: all buckets again, no chunk twice.
    store.rewrite(INDEX_DIGESTS, store.read(INDEX_DIGESTS).filter("false"), "semantic_id")
    _, came, gone = indexed("r3", rows)
    assert len(came) == len(gone) == 8 and chunks(store) == expected(rows)
    # Another semantic id in the same index, with its own layout, is left alone.
    other = DocumentSpec("other", "source", "{name}", chunk_size=100, chunk_overlap=0)
    indexed("r4", rows, other)
    assert indexed("r5", rows)[1:] == (set(), set())
    assert store.read(INDEX_TABLE).filter("semantic_id = 'other'").count() == 40
    removed = store.drop_partition(INDEX_TABLE, "docs")
    assert removed == len(expected(rows)) and store.remove_dead(INDEX_TABLE) > 0
    _, came, _ = indexed("r6", rows)
    assert len(came) == 8
    assert store.read(INDEX_TABLE).filter("semantic_id = 'docs'").count() == len(expected(rows))
    assert jobs.BUCKET not in store.read(INDEX_TABLE).columns
