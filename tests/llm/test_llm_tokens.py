"""Token ids, token files and packing against the tokenizer itself."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from llm_cases import EMPTY_SCHEMA, odd_documents
from millrace.llm.addressable_codes import TokenFile, read_token_files, write_token_files
from millrace.llm import harmonic_packing
from millrace.llm.harmonic_packing import cut_lengths, cut_texts, pack_documents
from millrace.llm.tokens import text_tokenizer

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")
ODD_TEXTS = [
    "", "  a", " a  b   c ", "a\n\nb", "a \n b\t\tc", "x<|endoftext|> y", "<|ENDOFTEXT|>", "é́  z",
    "a\x1fb c", "don't  'tis it's", "a b \x1c c", "1 23  4\r\n5", " ", "\n", "\n a", "a\n",
    "WORD.,  Σας ΣΑΣ. X!!'s a.'ll", "  \n x", "日本語 。テスト", "a.b. c,|d", None,
]


@pytest.mark.parametrize("name", FILES)
def test_ids_are_those_of_the_tokenizer(name):
    path = public_tokenizers.path(name)
    ids, counts = text_tokenizer(path).encode(pa.array(ODD_TEXTS * 2))
    plain = Tokenizer.from_file(path)
    ends = np.cumsum(counts)
    for i, text in enumerate(ODD_TEXTS * 2):
        expected = plain.encode(text or "", add_special_tokens=False).ids
        assert ids[ends[i] - counts[i] : ends[i]].tolist() == expected, text


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 5000])
def test_any_id_is_addressable(size):
    rng = np.random.default_rng(size)
    ids = (rng.integers(0, 1 << 32, size) >> rng.integers(0, 32, size)).astype(np.uint32)
    data = TokenFile.pack(ids, np.arange(2), np.ones(2), np.array([size // 2, size]))
    file = TokenFile(data)
    assert (file.ids() == ids).all()
    places = rng.permutation(size)
    assert (file.get(places) == ids[places]).all()
    with pytest.raises(ValueError):
        TokenFile(b"something else")


def expected_ids(name, text, end_id=1):
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    return plain.encode(text or "", add_special_tokens=False).ids + [end_id]


def test_token_files_hold_every_document(spark, scratch, tmp_path):
    docs = odd_documents(spark)
    folder = str(tmp_path / "files")
    files = write_token_files(
        docs, folder, tokenizer=public_tokenizers.path(FILES[0]), end_id=1, scratch=scratch
    )
    got = read_token_files(scratch.stage(files), folder).orderBy("start").collect()
    rows = sorted(
        docs.select("doc_id", "text").collect(),
        key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""),
    )
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    start = 0
    for row, (_, text) in zip(got, rows):
        ids = expected_ids(FILES[0], text)
        assert row.ids == ids and row.n_tokens == len(ids) and row.start == start
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = spark.createDataFrame([], EMPTY_SCHEMA)
    none = write_token_files(
        empty, folder, tokenizer=public_tokenizers.path(FILES[0]), end_id=1, scratch=scratch
    )
    assert read_token_files(scratch.stage(none), folder).count() == 0


def test_cut_lengths():
    lengths, pieces = cut_lengths(np.array([0, 1, 63, 64, 2048, 2049, 5000]), 2048)
    assert pieces.tolist() == [0, 1, 1, 1, 1, 2, 6]
    assert lengths.tolist() == [1, 63, 64, 2048, 2048, 1, 2048, 2048, 512, 256, 128, 8]


@pytest.mark.parametrize("capacity", [2048, 96, 7])
def test_packing_holds_each_id_once(spark, scratch, capacity):
    docs = odd_documents(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = pack_documents(
        docs, tokenizer=public_tokenizers.path(FILES[1]), end_id=1, capacity=capacity,
        scratch=scratch,
    ).collect()
    found, sequences = {}, {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length > 0
        assert p.start == len(found.setdefault(p.doc_id, []))
        found[p.doc_id] += ids
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert found == {
        r.doc_id: expected_ids(FILES[1], r.text) for r in docs.select("doc_id", "text").collect()
    }
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(map(len, found.values()))
    assert len(sequences) <= total / capacity * 1.1 + 2


def test_packing_tokenizes_small_slices(monkeypatch):
    """A task makes arrays of a mebibyte of text at a time, and a long text alone."""
    asked = []

    class Bytes:
        def encode(self, texts):
            sizes = np.array([len(t) for t in texts.to_pylist()], np.int64)
            asked.append(int(sizes.sum()))
            return np.ones(sizes.sum(), np.uint16), sizes

    monkeypatch.setattr(harmonic_packing, "text_tokenizer", lambda path: Bytes())
    texts = ["a" * 1000] * 4000 + ["b" * 3_000_000, "c"]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"]
    )
    pieces = pa.Table.from_batches(cut_texts(iter([batch]), "", 1, 2048, 0))
    assert sum(asked) == 7_000_001
    assert max(asked) == 3_000_000 and sorted(asked)[-2] <= 1 << 20
    assert sum(pieces.column("length").to_pylist()) == sum(asked) + len(texts)
    numbered = zip(pieces.column("class").to_pylist(), pieces.column("number").to_pylist())
    assert len(set(numbered)) == pieces.num_rows


def test_packing_repeats_and_nothing(spark, scratch):
    path = public_tokenizers.path(FILES[1])
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    pieces = pack_documents(twice, tokenizer=path, end_id=1, scratch=scratch)
    assert sum(p.length for p in pieces.collect()) == 2 * len(expected_ids(FILES[1], "a b"))
    empty = spark.createDataFrame([], EMPTY_SCHEMA)
    assert pack_documents(empty, tokenizer=path, end_id=1, scratch=scratch).count() == 0
