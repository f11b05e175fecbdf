"""Duplicates against brute force."""

import hashlib
import json
import os
import tracemalloc
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_cases import BODY, EMPTY_SCHEMA, odd_documents
from millrace.llm import bag_minhash, pigeonhole_join
from millrace.llm.bag_minhash import near_duplicates, without_near_duplicates
from millrace.llm.components import connected_components
from millrace.llm.exact_dedup import content_hash, exact_duplicates
from millrace.llm.pigeonhole_join import near_vectors
from millrace.scratch import Scratch


def classes_of(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hash_of", [content_hash, lambda text: F.length(text) % 3])
def test_exact_duplicates(spark, scratch, keep, hash_of):
    docs = odd_documents(spark)
    got = exact_duplicates(docs, scratch=scratch, keep=keep, hash_of=hash_of).collect()
    groups = {}
    for r in docs.select("doc_id", "text").collect():
        groups.setdefault(r.text or "", []).append(r.doc_id)
    assert len(got) == docs.count()
    assert sum(r.kept for r in got) == len(groups)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r.text_sha256]
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        assert (r.keep_id, r.group_size) == (best, len(ids)) and r.doc_id in ids
        assert not r.kept or r.doc_id == best


def test_exact_duplicates_of_nothing(spark, scratch):
    empty = spark.createDataFrame([], EMPTY_SCHEMA)
    assert exact_duplicates(empty, scratch=scratch).count() == 0


def shingle_counts(text):
    words = (text or "").lower().split()
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else None


def similar(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def edited_texts(n, seed=5):
    """Groups of edited copies, some by a little and some by more than the limit."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(n):
        base = [f"w{i}" for i in rng.integers(0, 5000, 80)] + ["again"] * 12
        for _ in range(int(rng.integers(1, 9))):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 4))):
                words[at] = f"e{rng.integers(0, 99)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("rounds,tile", [(0, 1024), (0, 2), (12, 1024)])
def test_near_duplicates(spark, scratch, monkeypatch, rounds, tile):
    monkeypatch.setattr(bag_minhash, "COMPARISONS", 0 if rounds else 10**9)
    monkeypatch.setattr(bag_minhash, "TILE_ROWS", tile)
    texts = edited_texts(25)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    counts = [shingle_counts(t) for t in texts]
    pairs = [
        (i, j) for i, j in combinations(range(len(texts)), 2)
        if similar(counts[i], counts[j]) >= 0.8
    ]
    got = {r.doc_id: r.class_id for r in near_duplicates(docs, scratch=scratch).collect()}
    assert got == classes_of(range(len(texts)), pairs)


def test_a_large_group_of_near_copies(spark, scratch):
    """No text is close to all others; the links among 2,000 are found in tiles."""
    rng = np.random.default_rng(21)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(2000):
        words = list(base)
        for at in rng.choice(90, int(rng.integers(1, 5)), replace=False):
            words[at] = f"e{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    number = {}
    has = np.zeros((len(texts), 60_000), np.float32)
    for i, text in enumerate(texts):
        for shingle in shingle_counts(text):
            has[i, number.setdefault(shingle, len(number))] = 1
    shared = has[:, : len(number)] @ has[:, : len(number)].T
    close = shared / (2 * 86 - shared) >= 0.8
    pairs = zip(*(x.tolist() for x in np.nonzero(np.triu(close, 1))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs, scratch=scratch).collect()}
    want = classes_of(range(len(texts)), pairs)
    assert 1 < len(set(want.values())) < len(texts)
    assert got == want


@pytest.mark.parametrize("counted,dense", [(1 << 22, 64), (50, 64), (50, 1), (200, 10**9)])
def test_common_counts(monkeypatch, counted, dense):
    monkeypatch.setattr(bag_minhash, "COUNTED", counted)
    monkeypatch.setattr(bag_minhash, "DENSE", dense)
    rng = np.random.default_rng(counted)
    draw = [rng.choice(60, int(rng.integers(0, 40)), replace=False) for _ in range(25)]
    left, right = draw[:10], draw[10:]
    want = [[len(set(a) & set(b)) for b in right] for a in left]
    assert bag_minhash.common_counts(left, right).tolist() == want
    nothing = [np.zeros(0, np.int64)]
    assert bag_minhash.common_counts(nothing, nothing * 2).tolist() == [[0, 0]]


def test_rows_without_ids_do_not_meet_each_other(spark, scratch):
    """Many rows without an id, copies among them, are near duplicates of their own kind."""
    texts = edited_texts(12, seed=9)
    rows = [(None, t) for t in texts] + [(None, texts[0])] * 500 + [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = near_duplicates(docs, scratch=scratch).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(bytes(r.text_key), set()).add(r.class_id)
    assert all(len(classes) == 1 for classes in by_text.values())
    counts = [shingle_counts(t) for t in texts]
    pairs = [
        (i, j) for i, j in combinations(range(len(texts)), 2) if similar(counts[i], counts[j]) >= 0.8
    ]
    want = classes_of(range(len(texts)), pairs)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    values = rng.integers(1, 1 << 62, 400).astype(np.uint64)
    one, two = rng.integers(1, 40, 400), rng.integers(1, 40, 400)
    both = np.concatenate([values, values])
    owner = np.repeat([0, 1], 400)
    a, b = bag_minhash.signatures(both, owner, np.concatenate([one, two]), 2, m=4096)
    truth = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((a == b).mean() - truth) < 0.03


def test_near_duplicates_of_odd_documents(spark, scratch):
    docs = odd_documents(spark)
    got = near_duplicates(docs, scratch=scratch).collect()
    assert len(got) == docs.count()
    classes = {(r.doc_id, bytes(r.text_key)): r.class_id for r in got}
    assert {c for (i, _), c in classes.items() if i in (1, 2)} == {1}
    assert {c for (i, _), c in classes.items() if i in (4, 5, 6)} == {4}
    assert {c for (i, _), c in classes.items() if i in (7, 8)} == {7}
    kept = without_near_duplicates(docs, scratch=scratch)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert (None, "alone and without an id") in rows and (1, BODY) in rows
    assert not {2, 3, 5, 6, 8} & {i for i, _ in rows}
    empty = spark.createDataFrame([], EMPTY_SCHEMA)
    assert near_duplicates(empty, scratch=scratch).count() == 0


def test_components_of_a_long_chain(spark, scratch):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(df, scratch).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def clustered_vectors(n, dims=64, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        center = rng.normal(size=dims)
        for _ in range(int(rng.integers(1, 6))):
            vector = center + rng.normal(size=dims) * rng.uniform(0, 0.35)
            rows.append(([float(x) for x in vector.astype(np.float32)], int(rng.integers(0, 2))))
    rows += [rows[0]] * 3 + [([2 * x for x in rows[0][0]], rows[0][1])]
    return [(i, v, k) for i, (v, k) in enumerate(rows)]


@pytest.mark.parametrize("tile,cell", [(512, 2000), (8, 2)])
def test_near_vectors(spark, scratch, monkeypatch, tile, cell):
    monkeypatch.setattr(pigeonhole_join, "TILE_ROWS", tile)
    monkeypatch.setattr(pigeonhole_join, "CELL_ROWS", cell)
    rows = clustered_vectors(60)
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [0.0] * 64, [nan] * 64, [inf] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0]]
    rows += [(1000 + i, v, 0) for i, v in enumerate(bad)]
    rows += [(2000, rows[0][1], None), (2001, [1.0, 2.1], 0)]
    schema = "vec_id long, embedding array<float>, label int, node string"
    df = spark.createDataFrame([(*r, "x") for r in rows], schema).repartition(3)
    got = {r.vec_id: r for r in near_vectors(df, scratch=scratch).collect()}
    links, good = [], {}
    for i, v, k in rows:
        if v and k is not None and None not in v and np.isfinite(v).all() and any(v):
            good[i] = (np.array(v, np.float32).astype(float), k)
    for (i, (v, k)), (j, (w, m)) in combinations(good.items(), 2):
        if k == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
            links.append((i, j))
    count = Counter(i for pair in links for i in pair)
    classes = classes_of([r[0] for r in rows], links)
    assert len(links) > 60
    assert {i: r.n_links for i, r in got.items()} == {r[0]: count[r[0]] for r in rows}
    assert {i: r.component_id for i, r in got.items()} == classes
    assert all(r.kept == (i == classes[i]) for i, r in got.items())
    assert near_vectors(df.filter("false"), scratch=scratch).count() == 0


def test_vectors_keep_the_precision_of_their_column(spark, scratch):
    """Two doubles a little below the threshold, which rounds above it in singles."""
    y = np.sqrt(1 - 0.93**2)
    rows = [(1, [1.0, 0.0], 0), (2, [0.93 - 1e-9, float(y)], 0), (3, [0.93 + 1e-9, -float(y)], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in near_vectors(df, scratch=scratch).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_dense_tiles_take_little_memory():
    """All pairs of a tile are close: a block of them is held, never all."""
    n, dims = 1500, 64
    rng = np.random.default_rng(2)
    vectors = np.ones(dims) + rng.normal(size=(n, dims)) * 0.02
    flat = pa.array(vectors.ravel())
    offsets = pa.array(np.arange(n + 1) * dims, pa.int32())
    true = pa.array(np.ones(n, bool))
    tile = pa.table({
        "node": pa.array(np.arange(n)), "copies": pa.array(np.ones(n, np.int64)),
        "unit": pa.ListArray.from_arrays(offsets, flat), "block": pa.array(np.zeros(n, np.int32)),
        "home": true, "left": true, "right": true,
    })
    tracemalloc.start()
    found = pigeonhole_join.tile_links(tile, 0.93)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250 << 20
    assert found.column("links").to_pylist() == [n - 1] * n
    assert set(found.column("other").to_pylist()) == {0}


def near_and_far(n, dims, seed):
    """Singles in groups whose cosines lie on both sides of 0.93, and copies with -0.0 for 0.0."""
    rng = np.random.default_rng(seed)
    center = rng.normal(size=(n // 8, dims))
    vectors = center[rng.integers(0, len(center), n)] + rng.normal(size=(n, dims)) * rng.uniform(0, 0.4, (n, 1))
    vectors[:20, 3] = 0.0
    vectors = vectors.astype(np.float32)
    vectors[:10] = vectors[10:20]
    vectors[:10, 3] = -0.0
    return vectors


def cosines(vectors):
    exact = vectors.astype(float)
    length = np.sqrt((exact * exact).sum(1))
    return exact @ exact.T / np.outer(length, length)


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


@pytest.mark.parametrize("clash", [False, True])
def test_a_vector_is_written_once_for_all_its_cells(spark, tmp_path, monkeypatch, clash):
    """Staged tables hold each vector once, also where its range reaches many cells."""
    if clash:
        one = lambda kind, unit: [F.size(unit).alias("hash")]
        monkeypatch.setattr(pigeonhole_join, "digest", one)
    monkeypatch.setattr(pigeonhole_join, "TILE_ROWS", 700)
    monkeypatch.setattr(pigeonhole_join, "CELL_ROWS", 50)
    vectors = near_and_far(3000, 64, seed=4)
    kinds = (np.arange(len(vectors)) // 10 % 7 > 0).astype(int)
    rows = [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(vectors, kinds))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    scratch = Scratch(spark, str(tmp_path))
    got = {r.vec_id: r for r in near_vectors(df, scratch=scratch).collect()}
    linked = np.triu((cosines(vectors) >= 0.93) & (kinds[:, None] == kinds[None, :]), 1)
    pairs = list(zip(*(x.tolist() for x in np.nonzero(linked))))
    count = Counter(i for pair in pairs for i in pair)
    classes = classes_of(range(len(rows)), pairs)
    assert len(pairs) > 1000
    assert {i: r.n_links for i, r in got.items()} == {i: count[i] for i in range(len(rows))}
    assert {i: r.component_id for i, r in got.items()} == classes
    assert folder_bytes(tmp_path) < (4 if clash else 3) * vectors.nbytes


@pytest.mark.parametrize("dims,cell_rows", [(64, 20), (64, 10_000), (40, 7), (5, 3)])
@pytest.mark.parametrize("sides", ["one", "two", "mixed"])
def test_tile_links(dims, cell_rows, sides):
    """Links by cells are those of all pairs of a left and a right row."""
    vectors = near_and_far(400, dims, seed=dims)
    n = len(vectors)
    vectors[37] = 1e-30  # whose square is still a double
    rng = np.random.default_rng(1)
    left = rng.random(n) < {"one": 2, "two": 0.5, "mixed": 0.6}[sides]
    right = ~left if sides == "two" else rng.random(n) < {"one": 2, "mixed": 0.6}[sides]
    copies = rng.integers(1, 4, n)
    offsets = pa.array(np.arange(n + 1) * dims, pa.int32())
    tile = pa.table({
        "node": pa.array(np.arange(n) + 1000), "copies": pa.array(copies),
        "unit": pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel())),
        "left": pa.array(left), "right": pa.array(right),
    })
    meet = left[:, None] & right[None, :]
    linked = (cosines(vectors) >= 0.93) & (meet | meet.T) & ~np.eye(n, dtype=bool)
    found = pigeonhole_join.tile_links(tile, 0.93, cell_rows).to_pydict()
    want = linked @ copies
    assert dict(zip(found["node"], found["links"])) == {i + 1000: int(want[i]) for i in np.flatnonzero(want)}
    classes = classes_of(range(n), zip(*(x.tolist() for x in np.nonzero(linked))))
    assert {i - 1000: j - 1000 for i, j in zip(found["node"], found["other"])} == {
        i: classes[i] for i in np.flatnonzero(want)
    }


def test_tiles_of_groups():
    """Shared groups meet themselves; of a large kind all pairs of sides meet once."""
    held = [(g, f"file:/x/part-{g}.parquet", n) for g, n in enumerate([9, 3, 3, 3, 5, 7])]
    tiles = []
    for (task,) in pigeonhole_join._tasks(held, [(2, 6, 6)]):
        task = json.loads(task)
        for right in task["right"]:
            tiles.append(tuple(tuple(g for _, g in side) for side in (task["left"], right)))
    sides = [(2, 3), (4,), (5,)]
    want = [((0,), ()), ((1,), ())] + [(s, ()) for s in sides] + list(combinations(sides, 2))
    assert sorted(tiles) == sorted(want)
