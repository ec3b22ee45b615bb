"""Packing, token store and vocabulary against the tokenizers library."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, token_counts, token_store, vocab
from tidemark.llm.vocab import encoder, vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
ODD = [
    "", " ", "\n", "  a  b\n\n c", "don't I'LL we'Ve 's", "x<|endoftext|>y <|startoftext|> z", "<|endoftext|>" * 3,
    "ΣίΣΑΣ İstanbul é ǅ ²Ⅷ½ ٣٤", "\U0001f600 \U0001d400\U0001d401 a",
    "\x1c\x1d a b　c\x85", "A" * 5000, "漢字 한글", "_a_b__", "​﻿x", "a<|endoftext", "\x00\x01", "ﬁ ẞ",
]


def ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_equals_the_library(path):
    enc, library = encoder(path), Tokenizer.from_file(path)
    for text in ODD:
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), np.uint32).tolist() == want, text[:40]

    @given(st.text(max_size=60))
    @settings(max_examples=300, deadline=None)
    def same(text):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(enc.encode(text), np.uint32).tolist() == want

    same()


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_blocks_equal_the_library(path, monkeypatch):
    enc, library = encoder(path), Tokenizer.from_file(path)
    texts = [None, *ODD, "the end. " * 50, "a\u3000b\x85c\xa0d it's x1y2", "\u0378 new", *ODD[::-1]]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]

    def same():
        return [np.frombuffer(x, np.uint32).tolist() for x in enc.encode_all(texts)] == want

    for block in [1, 40, 4_000_000]:
        monkeypatch.setattr(vocab, "BLOCK_CHARS", block)
        enc.forget()
        assert same() and same()
        monkeypatch.setattr(vocab, "CACHE_CHARS", 30)
        assert same()
        monkeypatch.undo()
    assert enc.encode_all([]) == [] and enc.encode_all([""]) == [b""]

    @given(st.lists(st.text(max_size=30), max_size=5))
    @settings(max_examples=200, deadline=None)
    def alike(texts):
        assert enc.encode_all(texts) == [enc.encode(t) for t in texts]

    alike()


def test_runs_of_a_block_are_learned_together(monkeypatch):
    enc, calls = encoder(WORDS), []
    enc.forget()
    merger = enc.merger

    class Counted:
        def encode_ordinary(self, text):
            calls.append(len(text))
            return merger.encode_ordinary(text)

    monkeypatch.setattr(enc, "merger", Counted())
    texts = [f"shared word{chr(97 + k % 26)}{'xyz' * (k // 26)}" for k in range(200)]
    got = enc.encode_all(texts)
    assert len(calls) == 1
    library = Tokenizer.from_file(WORDS)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, np.uint32).tolist() for x in got] == want


@given(st.lists(st.integers(1, 6000), max_size=60), st.booleans())
@settings(max_examples=200, deadline=None)
def test_pack_covers_each_token_once(lengths, last):
    windows, rest = packing.pack([(0, n) for n in lengths], last=last)
    seen = {}
    for tier, pieces in windows:
        size = sum(n for _, _, n in pieces)
        assert size <= tier and (size == tier or (last and tier == 2048))
        for doc, at, n in pieces:
            seen.setdefault(doc, []).append((at, n))
    for doc, at, n in rest:
        seen.setdefault(doc, []).append((at, n))
    assert last is False or not rest
    assert sum(n for _, _, n in rest) < 256
    assert sum(sum(n for _, _, n in p) < t for t, p in windows) <= 1
    assert set(seen) == set(range(len(lengths)))
    for doc, parts in seen.items():
        at = 0
        for a, n in sorted(parts):
            assert a == at and n > 0
            at += n
        assert at == lengths[doc]


def test_steps_are_balanced():
    windows = [(t, None) for t in [2048] * 33 + [1024] * 21 + [512] * 13 + [256] * 40]
    groups = packing.deal_steps(windows, 16_384)
    load = {}
    for (t, _), g in zip(windows, groups):
        load[g] = load.get(g, 0) + t
    assert max(load.values()) - min(load.values()) <= 256


def docs(spark, rows):
    schema = "sequence_id string, doc_id long, text string, ids int, part string"
    return spark.createDataFrame([("x", d, t, 1, "y") for d, t in rows], schema)


ROWS = [(5, "a b c"), (5, "a b c"), (None, "null id"), (3, None), (1, ""), (2, "word " * 9000), (7, "zz\nyy")]


@pytest.mark.parametrize("block", [50, 2_000_000])
def test_pack_documents(spark, block):
    out = packing.pack_documents(docs(spark, ROWS), BYTES, 1, block_tokens=block).collect()
    by_sequence, by_doc = {}, {}
    for r in out:
        part = np.frombuffer(r.ids, np.uint32)
        assert len(part) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
        by_doc.setdefault(r.doc_id, []).append((r.start, part.tolist(), r.doc_tokens))
    for parts in by_sequence.values():
        at = 0
        for offset, n, tier in sorted(parts):
            assert offset == at
            at += n
        assert at <= tier
    for doc, text in dict(ROWS).items():
        want = (ids(BYTES, text) + [1]) * sum(d == doc for d, _ in ROWS)
        got = [x for _, p, _ in sorted(by_doc[doc]) for x in p]
        assert sorted(got) == sorted(want) if doc == 5 else got == want
    assert not packing.pack_documents(docs(spark, []), BYTES, 1).collect()


def test_token_store(spark, tmp_path):
    target = str(tmp_path / "tokens")
    token_store.write_tokens(docs(spark, ROWS), target, WORDS, 2)
    got = token_store.read_tokens(spark, target).orderBy("start").collect()
    at = 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [d for d, _ in order]
    for r, (_, text) in zip(got, order):
        want = ids(WORDS, text) + [2]
        assert (r.start, r.n_tokens, list(r.ids)) == (at, len(want), want)
        at += len(want)
    crc = {r.start: r.ids_crc32 for r in token_store.with_crc32(token_store.read_tokens(spark, target)).collect()}
    assert all(crc[r.start] == zlib.crc32(np.array(r.ids, np.uint32).tobytes()) for r in got)
    from pyspark.sql import functions as F

    one = token_store.read_tokens(spark, target, F.col("doc_id") == 7)
    assert [r.doc_id for r in one.collect()] == [7]
    assert "EqualTo(doc_id,7)" in one._jdf.queryExecution().toString()


def test_token_store_batches_by_bytes(spark, tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_store, "BATCH_BYTES", 10)
    texts = ["a" * 4, None, "", "b" * 30, "c", "é" * 4, "d" * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(token_store._batches(batch))
    assert [x for p in parts for x in p.column(1).to_pylist()] == texts
    assert len(parts) > 2 and all(p.num_rows for p in parts)
    assert not list(token_store._batches(batch.slice(0, 0)))


def test_empty_token_store(spark, tmp_path):
    target = str(tmp_path / "none")
    token_store.write_tokens(docs(spark, []), target, WORDS, 2)
    assert not token_store.read_tokens(spark, target).collect()


@pytest.mark.parametrize("chars", [40, 16_000_000])
def test_token_counts(spark, chars):
    rows = ROWS + [(20 + i, t) for i, t in enumerate(ODD)] + [(90, "the " * 1000 + "end")]
    out = token_counts.count_tokens(docs(spark, rows), BYTES, chars).collect()
    want = [(d, len((t or "").encode()), len(ids(BYTES, t))) for d, t in rows]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert not token_counts.count_tokens(docs(spark, []), BYTES).collect()
