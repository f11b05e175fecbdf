"""Nearest neighbours against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import multiprobe
from millrace.llm.multiprobe import Hashing, dense, nearest_neighbours, perturbations, probes_needed

SCHEMA = "vec_id long, embedding array<double>, label int, score double, query_id string"


def frame(spark, pairs):
    return spark.createDataFrame([(i, v, 1, 0.5, "x") for i, v in pairs], SCHEMA)


def brute(pairs, asks, k):
    """Ids and scores of the k best, by id; rows that repeat id and vector count once."""
    good = {
        (i, tuple(v)) for i, v in pairs
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)
    }
    found = {}
    for i, v in good:
        if asks(i):
            scores = sorted((-float(np.dot(v, w)), j) for j, w in good if j != i)
            found[i] = [(j, -s) for s, j in scores[:k]]
    return found


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.mark.parametrize("unlike", [True, False])
def test_recall_and_scores(spark, scratch, unlike):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 16)) * rng.uniform(0.2, 2, (3000, 1))
    if not unlike:  # a third of all rows close to one vector, many of them equal
        vectors[::3] = vectors[0] + np.round(rng.normal(size=(1000, 16)), 0) * 0.01
    pairs = [(i, v.tolist()) for i, v in enumerate(vectors)]
    got = answers(nearest_neighbours(frame(spark, pairs), F.col("vec_id") % 20 == 0, 10, scratch=scratch))
    want = brute(pairs, lambda i: i % 20 == 0, 10)
    assert got.keys() == want.keys()
    hits = 0
    for i, found in got.items():
        assert len(found) == 10 and len({j for j, _ in found}) == 10
        for j, score in found:
            assert j != i and score == pytest.approx(float(vectors[i] @ vectors[j]), rel=1e-12)
        # As good a score counts: equal vectors stand for each other.
        least = want[i][-1][1] - 1e-12
        hits += sum(score >= least for _, score in found)
    assert hits >= 0.9 * 10 * len(want)


def test_odd_rows(spark, scratch):
    nan, inf = float("nan"), float("inf")
    pairs = [
        (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]),
        (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [9.0, 9.0]),
        (20, [3.0]), (40, [0.0, 5.0, 1.0]), (60, [-1.0, -1.0]), (80, []),
    ]
    got = answers(nearest_neighbours(frame(spark, pairs), F.col("vec_id") % 20 == 0, 20, scratch=scratch))
    assert got.keys() == {0, 20, 40, 60}
    # Few rows share all buckets: ties by id, short vectors filled with zeros.
    assert [j for j, _ in got[0]][:3] == [20, 1, 2]
    assert got[0][0][1] == 3.0
    for i, found in got.items():
        assert i not in [j for j, _ in found] and not {3, 4, 5, 6, 7, 80} & {j for j, _ in found}


def test_many_copies_and_nothing(spark, scratch):
    same = [(i, [0.6, 0.8]) for i in range(0, 3000, 2)]
    got = answers(nearest_neighbours(frame(spark, same), F.col("vec_id") % 20 == 0, 5, scratch=scratch))
    assert len(got) == 150
    for i, found in got.items():
        assert [j for j, _ in found] == [j for j in range(0, 14, 2) if j != i][:5]
    nothing = nearest_neighbours(frame(spark, []), F.lit(True), 5, scratch=scratch)
    assert nothing.count() == 0 and nothing.columns == ["query_id", "rank", "vec_id", "score"]
    assert nearest_neighbours(frame(spark, same), F.lit(False), 5, scratch=scratch).count() == 0


def test_tiles_change_nothing(spark, scratch, monkeypatch):
    rng = np.random.default_rng(5)
    pairs = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(600, 8)))]
    df, asks = frame(spark, pairs), F.col("vec_id") % 4 == 0
    whole = answers(nearest_neighbours(df, asks, 5, scratch=scratch))
    monkeypatch.setattr(multiprobe, "TILE_ROWS", 16)
    assert answers(nearest_neighbours(df, asks, 5, scratch=scratch)) == whole


def test_visits_hold_what_the_fit_says():
    rng = np.random.default_rng(7)
    points = rng.normal(size=(400, 12))
    points /= np.linalg.norm(points, axis=1)[:, None]
    hashing = Hashing.draw(points, 4)
    hashing.likeness, hashing.probes = 0.5, 6
    owner = np.repeat(np.arange(20), 20)
    needed = probes_needed(hashing, points[:20], points, owner)
    steps = perturbations(4)
    assert len(steps) == 81 and not steps[0].any()
    slots, found = hashing.slots(points), np.zeros(400, bool)
    for table, part in enumerate(hashing.tables):
        visits = hashing.visits(points[:20], table, steps)
        assert (visits[:, :1] != visits[:, 1:]).all()
        home = hashing.buckets(slots[:, part], table)
        found |= (visits[owner] == home[:, None]).any(1)
    assert (found == (needed <= 6)).all()


def test_lists_become_rows():
    lists = pa.array([[1.0], [2.0, 3.0], []], pa.list_(pa.float32()))
    assert dense(lists, 2).tolist() == [[1, 0], [2, 3], [0, 0]]
    assert dense(lists.slice(1, 1), 2).tolist() == [[2, 3]]
