"""Source divergence and filter orders against brute force."""

import re
import tracemalloc
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_cases import EMPTY_SCHEMA, odd_documents
from millrace.llm import divergence
from millrace.llm.divergence import SLICE, count_documents, source_divergence, words_of
from millrace.llm.filter_orders import audit_filters, filter_orders
from millrace.llm.perfect_hash import PerfectHash, build_shard, shard_numbers, word_hashes

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = ["", "Ab cD", "ÄÖ x", "a-b", "x" * 70000, "  ", "日本語 Test", "A", "\x00q\x7fr", "end"]


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("keys", [0, 1, 2, 1000, 40000])
def test_perfect_hash(keys):
    words = pa.array([f"w{i * 7}" for i in range(keys)], pa.string())
    of = shard_numbers(word_hashes(words), 3)
    shards = [build_shard(words.filter(pa.array(of == i))) for i in range(3)]
    whole = PerfectHash(shards, np.arange(3), 3)
    slots = whole.slots(words)
    assert sorted(slots.tolist()) == list(range(keys)) and len(whole) == keys
    assert whole.keys.take(pa.array(slots)).to_pylist() == words.to_pylist()
    others = pa.array(["", "x", "wé", *[f"v{i}" for i in range(5000)]])
    assert (whole.slots(others) == -1).all()
    # With one shard missing, its words are unknown and the others keep their order.
    some = PerfectHash(shards[1:], np.array([1, 2]), 3)
    found = some.slots(words)
    assert ((found >= 0) == (of > 0)).all()
    assert sorted(found[of > 0].tolist()) == list(range(int((of > 0).sum())))


def test_perfect_hash_of_colliding_keys(monkeypatch):
    from millrace.llm import perfect_hash

    monkeypatch.setattr(perfect_hash, "word_hashes", lambda w: np.arange(len(w), dtype=np.uint64) // 4)
    words = pa.array([f"w{i}" for i in range(20)])
    whole = PerfectHash([build_shard(words)], np.array([0]), 1)
    assert len(whole.spare) == 20
    assert sorted(whole.slots(words).tolist()) == list(range(20))


def test_words():
    words, owner = words_of(pa.array(TEXTS))
    want = [(i, w) for i, text in enumerate(TEXTS) for w in plain_words(text)]
    assert list(zip(owner.tolist(), words.to_pylist())) == want
    words, owner = words_of(pa.array(TEXTS).slice(2, 3))
    assert words.to_pylist() == [w for t in TEXTS[2:5] for w in plain_words(t)]


def brute_divergence(rows, least, leading):
    by_lang, groups, found = defaultdict(Counter), set(), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", plain_words(text)
        by_lang[lang].update(set(words))
        groups.add((lang, source))
        found[lang, source].update(words)
    out = set()
    for lang, source in groups:
        kept = [w for w, n in by_lang[lang].items() if n >= least]
        near = [s for other, s in groups if other == lang]

        def shares(names):
            counts = {w: sum(found[lang, s][w] for s in names) for w in kept}
            total = sum(counts.values())
            return {w: 1 + 10**9 * (n + 2) // (total + 2 * len(kept)) for w, n in counts.items()}

        p, q = shares([source]), shares(near)
        pairs = []
        for other in near:
            if other != source:
                r = shares([other])
                pairs.append((-sum((p[w] - r[w]) ** 2 // (p[w] + r[w]) for w in kept), other))
        terms = [
            (-((p[w] - q[w]) ** 2 // (p[w] + q[w])), w)
            for w in kept if found[lang, source][w] and p[w] > q[w]
        ]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(
                terms, key=lambda t: (t[0], t[1].encode()))[:leading])):
            out |= {(lang, source, part, w, -v, i + 1) for i, (v, w) in enumerate(items)}
    return out


def divergence_rows(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("limits", [None, (1, 4, 1)])
def test_divergence(spark, scratch, monkeypatch, limits):
    if limits:  # one pass per shard, tiny blocks of slots, counts emptied again and again
        for name, value in zip(("BROADCAST_BYTES", "BLOCK_CELLS", "DENSE_CELLS"), limits):
            monkeypatch.setattr(divergence, name, value)
        monkeypatch.setattr(divergence, "SHARD_KEYS", 5)
    docs = odd_documents(spark)
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    got = divergence_rows(source_divergence(docs, scratch=scratch, least_documents=2, leading=5))
    assert got == brute_divergence(rows, 2, 5)


def test_counting_documents_holds_little():
    """Arrays of a task stay small against 24 MB of text, whose counts are whole."""
    texts = [" ".join(f"word{chr(97 + (i + j) % 26)}" for j in range(400)) for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"]
    )
    counts = Counter()
    tracemalloc.start()
    for part in count_documents(iter([batch]), SLICE):
        counts.update(dict(zip(part.column("term").to_pylist(), part.column("n").to_pylist())))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts == {f"word{chr(97 + i)}": len(texts) for i in range(26)}
    assert peak < 64 << 20


def test_divergence_of_little(spark, scratch):
    empty = spark.createDataFrame([], EMPTY_SCHEMA)
    assert source_divergence(empty, scratch=scratch).count() == 0
    few = spark.createDataFrame(
        [(1, "a b", "en", "s1"), (2, None, "en", None), (3, "a", "fr", "s1")],
        "doc_id long, text string, lang string, source string",
    )
    assert divergence_rows(source_divergence(few, scratch=scratch)) == {
        ("en", "s1", "pair", "", 0, 1), ("en", "", "pair", "s1", 0, 1),
    }


def brute_orders(rows, labels):
    labels = [label for label in labels if label[0] is not None]
    good = {i for i, quality, _ in labels if quality == 1}
    toxic = {i for i, _, t in labels if t == 1}
    first = {}
    for i, _, text in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    parts = defaultdict(list)
    for i, part, text in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and first[text] < i,
        }
        parts[part or ""].append((i, {f for f, failed in fails.items() if failed}))
    out = set()
    for part, docs in parts.items():
        lines, removals = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left, gone = docs, []
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                redundant = sum(f in d[1] for d in gone)
                left, gone = [d for d in left if f not in d[1]], gone + here
                removals[f] += len(here)
                unique = sum(d[1] == {f} for d in docs)
                lost = [sum(d[0] in known for d in here) for known in (good, toxic)]
                lines.append((f, (part, order, step, len(left), len(here), redundant, unique, *lost)))
        out |= {(*line, removals[f]) for f, line in lines}
    return out


def test_filter_orders(spark, scratch):
    docs = odd_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "text").collect()]
    labels = [(1, 1, 0), (2, None, 1), (2, 1, None), (9, 0, 1), (11, 1, 1), (None, 1, 1), (77, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in audit_filters(docs, known, scratch=scratch).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_orders(rows, labels)
    nothing = audit_filters(spark.createDataFrame([], EMPTY_SCHEMA), known, scratch=scratch)
    assert nothing.count() == 0


def test_orders_of_other_filters(spark):
    cells = spark.createDataFrame(
        [("x", 0, 5, 1, 0), ("x", 3, 7, 2, 1)], "part string, mask int, n long, good long, toxic long"
    )
    got = {tuple(r) for r in filter_orders(cells, "PQ").collect()}
    assert got == {
        ("x", "PQ", 1, 5, 7, 0, 0, 2, 1, 7), ("x", "PQ", 2, 5, 0, 7, 0, 0, 0, 7),
        ("x", "QP", 1, 5, 7, 0, 0, 2, 1, 7), ("x", "QP", 2, 5, 0, 7, 0, 0, 0, 7),
    }
    with pytest.raises(ValueError):
        filter_orders(cells, "ABCDEFG")
    assert filter_orders(cells.filter(F.lit(False)), "PQ").count() == 0
