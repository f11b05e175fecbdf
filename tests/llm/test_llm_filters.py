"""Toxicity, line spread, mixing and language model."""

import math
import tracemalloc
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_cases import EMPTY_SCHEMA, odd_documents
from millrace.llm import backoff_automaton as lm
from millrace.llm import line_spread, toxicity
from millrace.llm.line_spread import without_boilerplate
from millrace.llm.mixing import leaf_budgets, mix_sources
from millrace.llm.toxicity import fit, fit_toxicity, score_texts, slot_pairs, without_toxic


def fitted(texts, labels):
    row, slot = slot_pairs(pa.array(texts))
    cells = np.split(slot, np.searchsorted(row, np.arange(1, len(texts))))
    return fit(cells, np.array(labels, float))


def labelled(n, seed):
    """Neither word is toxic; both together are."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for _ in range(n):
        has = rng.random(2) < 0.5
        words = [f"w{i}" for i in rng.integers(0, 300, 20)]
        words += [w for w, h in zip(("silly", "people"), has) if h]
        texts.append(" ".join(words))
        labels.append(int(has.all()))
    return texts, labels


def test_pairs_of_terms_are_learned():
    machine = fitted(*labelled(3000, 1))
    texts, labels = labelled(500, 2)
    predicted = machine.scores(pa.array(texts)) >= 0.5
    assert (predicted == np.array(labels)).mean() > 0.97


def either(n, seed):
    """One of the words makes a text toxic, both together do not: each tells nothing."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for _ in range(n):
        has = rng.random(2) < 0.5
        words = [f"w{i}" for i in rng.integers(0, 300, 10)]
        texts.append(" ".join(words + [w for w, h in zip(("silly", "people"), has) if h]))
        labels.append(int(has[0] != has[1]))
    return texts, np.array(labels)


@pytest.mark.parametrize("turned", [False, True])
def test_pairs_of_terms_that_tell_nothing_alone_are_learned(turned):
    texts, labels = either(4000, 5)
    machine = fitted(texts, labels ^ turned)
    texts, labels = either(500, 6)
    predicted = machine.scores(pa.array(texts)) >= 0.5
    assert (predicted == (labels ^ turned)).mean() > 0.97


def pairs_by_count(terms, labels):
    """Terms of telling pairs, one pair after the other."""

    def told(cells):
        total = 0.0
        for cell in set(cells):
            inside = labels[[c == cell for c in cells]]
            for k in (0, 1):
                got, expected = (inside == k).sum(), len(inside) * (labels == k).mean()
                total += 2 * got * np.log(got / expected) if got else 0
        return total

    seen = Counter(s for t in terms for s in t.tolist())
    common = [s for s, c in seen.items() if c >= max(2, toxicity.PAIR_SUPPORT * len(terms))]
    has = {s: [s in set(t.tolist()) for t in terms] for s in common}
    alone = {s: told(has[s]) for s in common}
    found = set()
    for a, b in combinations(common, 2):
        more = told(list(zip(has[a], has[b]))) - alone[a] - alone[b]
        if more >= toxicity.LEAST_PAIR_EVIDENCE:
            found |= {a, b}
    return found


@pytest.mark.parametrize("block", [3, 256])
def test_telling_pairs_are_found(monkeypatch, block):
    monkeypatch.setattr(toxicity, "PAIR_BLOCK", block)
    monkeypatch.setattr(toxicity, "LEAST_PAIR_EVIDENCE", 4.0)
    rng = np.random.default_rng(8)
    terms = [np.flatnonzero(rng.random(14) < 0.3) * 1001 for _ in range(150)]
    labels = np.array([(0 in t) != (1001 in t) for t in terms], float)
    expected = pairs_by_count(terms, labels)
    assert {0, 1001} <= expected and len(expected) < 14
    assert set(toxicity.paired_terms(terms, labels).tolist()) == expected


def test_toxicity(spark, scratch):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    machine = fit_toxicity(docs, labels, scratch=scratch)
    assert [r.score < 0.5 for r in score_texts(docs, machine).collect()] == [True] * docs.count()
    assert without_toxic(docs, machine).columns == docs.columns
    texts, toxic = labelled(600, 3)
    many = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = [(i, t, "x") for i, t in enumerate(toxic)] + [(0, None, "x"), (None, 1, "x")]
    labels = spark.createDataFrame(known, "doc_id long, toxic int, text string")
    machine = fit_toxicity(many, labels, scratch=scratch)
    kept = {r.doc_id for r in without_toxic(many, machine).collect()}
    assert np.mean([(i not in kept) == bool(t) for i, t in enumerate(toxic)]) > 0.9
    empty = spark.createDataFrame([], EMPTY_SCHEMA)
    assert score_texts(empty, machine).count() == without_toxic(empty, machine).count() == 0


@pytest.mark.parametrize("near", [0.2, 1.0])
def test_line_spread(spark, scratch, monkeypatch, near):
    monkeypatch.setattr(line_spread, "NEAR", near)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(300):
        lines = [f"line {i} {j} of its own text" for j in range(4)]
        lines += [f" shared {k} " for k in rng.integers(0, 60, 3)] + ["", "everywhere"]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{rng.integers(0, 12)}"))
    rows += [(i, "everywhere", f"s{i % 12}") for i in range(1000, 1020)]
    rows += [rows[0], (None, rows[1][1], None), (2000, None, "s1"), (2001, "", None)]
    schema = "doc_id long, text string, source string"
    df = spark.createDataFrame(rows, schema).withColumn("N_lines", F.lit(1))
    got = without_boilerplate(df, scratch=scratch, min_sites=5).collect()
    sites = {}
    for _, text, site in rows:
        for line in (text or "").split("\n"):
            if site is not None:
                sites.setdefault(line.strip(" "), set()).add(site)
    wide = {line for line, s in sites.items() if len(s) >= 5 and line}
    expected = []
    for i, text, site in rows:
        lines = (text or "").split("\n")
        real = [x.strip(" ") for x in lines if x.strip(" ")]
        bad = [x for x in real if x in wide]
        cut = bad and sum(map(len, bad)) <= 0.5 * sum(map(len, real))
        new = "\n".join(x for x in lines if x.strip(" ") not in wide) if cut else text
        expected.append((i, text, site, new, len(real), len(bad) if cut else 0))
    assert Counter(tuple(r) for r in got) == Counter(expected)
    assert len(wide) > 1 and any(e[5] for e in expected)
    empty = spark.createDataFrame([], EMPTY_SCHEMA)
    assert without_boilerplate(empty, scratch=scratch).count() == 0
    odd = odd_documents(spark)
    assert without_boilerplate(odd, scratch=scratch).count() == odd.count()


def test_line_spread_by_length(spark, scratch):
    """Long lines need few sites; short ones must stand more often than by chance."""
    rng = np.random.default_rng(6)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(400):
        own = [f"own{i}x{j} " + " ".join(rng.choice(["on", "it", "le"], 5)) for j in range(20)]
        lines = [*own, rng.choice(["On.", "It.", "Le."])]
        lines += ["Rights reserved."] * (i % 4 == 0) + [passage] * (i < 3)
        rows.append((i, "\n".join(lines), f"s{i % 20}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = without_boilerplate(df, scratch=scratch, long_sites=3, by_chance=True, min_sites=5)
    for r in got.collect():
        kept = r.cleaned_text.split("\n")
        assert passage not in kept and "Rights reserved." not in kept
        assert kept == [x for x in r.text.split("\n") if x not in (passage, "Rights reserved.")]
    got = without_boilerplate(df, scratch=scratch, long_sites=4, by_chance=True, min_sites=5)
    assert sum(passage in r.cleaned_text for r in got.collect()) == 3


def test_shortages_go_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 100), ("a", "y", 1000), ("b", "z", 5000), ("c", "w", 9)],
        "top string, leaf string, tokens long",
    )
    weights = {"top": {"a": 1, "b": 1, "c": 0}}
    got = {
        r.leaf: r.budget for r in leaf_budgets(leaves, ["top", "leaf"], weights, 2000, 1).collect()
    }
    # x lacks 400 of its 500, y takes them; nothing leaves a.
    assert got == {"x": 100, "y": 900, "z": 1000, "w": 0}
    got = {
        r.leaf: r.budget for r in leaf_budgets(leaves, ["top", "leaf"], weights, 4000, 1).collect()
    }
    assert got == {"x": 100, "y": 1000, "z": 2900, "w": 0}


def test_mixing_takes_prefixes_of_epochs(spark, scratch):
    rows = [(i, "t " * (i % 5 + 1), "big" if i % 3 else "small") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mix_sources(
        df, levels={"source": F.col("source")}, weights={"source": {"small": 2}}, scratch=scratch,
        total_tokens=1200, max_epochs=3,
    ).collect()
    for name, budget in (("big", 400), ("small", 800)):
        own = [(r.row.c0, r.tokens, r.epoch) for r in got if r.source == name]
        available = [(i, len(t.split())) for i, t, s in rows if s == name]
        total = sum(n for _, n in available)
        full, rest = divmod(budget, total)
        assert {i for i, _, e in own if e <= full} == ({i for i, _ in available} if full else set())
        last = sorted(i for i, _, e in own if e == full + 1)
        assert max((e for *_, e in own), default=0) <= full + 1

        def key(i, epoch=full + 1):
            import hashlib

            return hashlib.md5(f"mix|{epoch}|{i}".encode()).hexdigest()

        used, prefix = 0, []
        for i, n in sorted(available, key=lambda x: key(x[0])):
            if used + n > rest:
                break
            used += n
            prefix.append(i)
        assert last == sorted(prefix)


def test_mixing_of_odd_documents(spark, scratch):
    levels = {"lang": F.col("lang"), "source": F.col("source")}
    odd = odd_documents(spark)
    got = mix_sources(odd, levels=levels, weights={}, scratch=scratch, max_epochs=1)
    assert got.count() == odd.count()
    empty = spark.createDataFrame([], EMPTY_SCHEMA)
    assert mix_sources(empty, levels=levels, weights={}, scratch=scratch).count() == 0
    with pytest.raises(ValueError):
        mix_sources(odd, levels=levels, weights={"lang": {"en": -1}}, scratch=scratch)


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\r\v\f":
        low = low.replace(blank, " ")
    return [w for w in low.split(" ") if w] + [None]


def zipf_texts():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 30) % 500) for _ in range(200)]
    return [*texts, "seldom seen words", "seldom seen words here", "", None, "quite new"]


def brute_scores(rows, learned, strength):
    """Tokens, known ones, add-one score and score of each text, and the model's parts."""
    train = [tokens_of(t) for t, known in zip(rows, learned) if known]
    counts = Counter(w for t in train for w in t)
    pairs = Counter(pair for t in train for pair in zip([None, *t[:-1]], t))
    total, kinds = sum(counts.values()), len(counts)
    n1, n2 = (sum(c == k for w, c in counts.items() if w is not None) for k in (1, 2))
    d = min(max(n1 / max(n1 + 2 * n2, 1), 0.1), 0.9)

    def probability(v, w):
        root = 1.0
        if total:
            root = (counts[w] - d) / total if counts[w] else d * kinds / total
        return (pairs[v, w] + strength * root) / (counts[v] + strength) if counts[v] else root

    out = []
    for text in rows:
        t = tokens_of(text)
        base = sum(math.log10((counts[w] + 1) / (total + kinds + 1)) for w in t)
        score = sum(math.log10(probability(v, w)) for v, w in zip([None, *t[:-1]], t))
        out.append((len(t), sum(counts[w] > 0 for w in t), base, score))
    return out, total, counts, probability


def check_scores(got, rows, learned, strength=lm.STRENGTH):
    expected, total, *_ = brute_scores([t for _, t in rows], learned, strength)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = sorted(((i, *e) for (i, _), e in zip(rows, expected)), key=key)
    found = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    assert len(found) == len(want) and {r.train_tokens for r in got} <= {total}
    for a, b in zip(found, want):
        assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:], rel=1e-9)


@pytest.mark.parametrize("shards", [None, 1])
def test_language_model(spark, scratch, monkeypatch, shards):
    """Odd texts, a seventh held out; with many shards most blocks hold a key or two."""
    if shards:
        monkeypatch.setattr(lm, "SHARD_BYTES", 1 << 40)
    docs = odd_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    learned = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    got = lm.score_texts(docs, ~lm.held_out(F.col("doc_id")), scratch=scratch).collect()
    check_scores(got, rows, learned)


def test_language_model_of_files(spark, scratch, tmp_path):
    """Read twice from files, in several slices."""
    texts = zipf_texts()
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(
        5
    ).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = lm.score_texts(docs, F.col("doc_id") < 204, scratch=scratch, strength=3.0).collect()
    check_scores(got, list(enumerate(texts)), [i < 204 for i in range(len(texts))], 3.0)
    _, _, counts, probability = brute_scores(texts, [i < 204 for i in range(len(texts))], 3.0)
    for v in (None, "w1", "seldom", "unseen!"):
        total = sum(probability(v, w) for w in counts) + probability(v, "unseen!")
        assert total == pytest.approx(1)


def test_language_model_of_nothing(spark, scratch):
    empty = spark.createDataFrame([], EMPTY_SCHEMA)
    got = lm.score_texts(odd_documents(spark), F.lit(False), scratch=scratch).collect()
    assert {(r.base_score, r.score, r.n_known) for r in got} == {(0.0, 0.0, 0)}
    assert len(got) == odd_documents(spark).count()
    assert lm.score_texts(empty, F.lit(True), scratch=scratch).count() == 0


def test_packed_numbers():
    for numbers in ([], [0], [0, 255], [256, 1], [(1 << 64) - 1, 0, 7]):
        assert lm.unpacked(lm.packed(np.array(numbers, np.uint64))).tolist() == numbers


def test_the_walk_follows_failure_arcs():
    """By hand: word 0 is a state with one arc, word 1 was never learned, 2 is the end."""
    totals = lm.Totals(10, 2, 0.5)
    automaton = lm.Automaton.of_counts(
        np.array([4, 0, 6]), np.array([0 * 3 + 2]), np.array([3]), totals, 2.0
    )
    assert automaton.state.tolist() == [1, 0, 3]
    path, ends = np.array([0, 2, 1, 0, 2]), np.array([2, 5])
    root = totals.root(np.array([4, 0, 6]))
    end_fails, word_fails = 2 / (6 + 2), 2 / (4 + 2)
    want = [end_fails * root[0], 3 / 6 + word_fails * root[2], end_fails * root[1], root[0],
            3 / 6 + word_fails * root[2]]
    assert 10 ** lm.walk(automaton, path, ends) == pytest.approx(want)


def test_terms_of_a_batch_take_little_memory():
    """Arrays of a task follow a slice of 8 MB of text: 15 MB; slices of 4 MB took 52 MB."""
    texts = [" ".join(f"w{(i * 7919 + j * 31) % 50021}" for j in range(300)) for i in range(4000)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(4000)), pa.array([0] * 4000, pa.int32()), pa.array(texts)],
        names=["doc_id", "toxic", "text"],
    )
    tracemalloc.start()
    found = sum(part.num_rows for part in toxicity.text_terms(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 4000
    assert peak < 25 << 20
