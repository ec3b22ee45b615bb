"""Configuration packing: whole documents, full sequences, counts close to the bound."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import config_packing as cp
from tidemark.llm.vocab import vocabulary


def histogram(lengths, size):
    return np.bincount(lengths, minlength=size + 1)


def held(groups):
    out = {}
    for pattern, times in groups:
        for length, k in pattern:
            out[length] = out.get(length, 0) + times * k
    return out


@pytest.mark.parametrize(
    "lengths, size, spare",
    [
        (np.random.default_rng(1).geometric(1 / 300, 6000).clip(1, 2048), 2048, 1),
        (np.random.default_rng(2).integers(1, 2049, 5000), 2048, 0.03),
        (np.random.default_rng(2).integers(400, 1400, 20000), 2048, 0.02),
        (np.full(1000, 700), 2048, None),  # two a sequence at best
        (np.full(10, 2048), 2048, 0),
        (np.full(999, 1), 8, 0),
        (np.array([4, 4, 3, 3, 2, 2, 2, 5, 7, 8]), 10, 0),
        (np.array([], int), 16, 0),
    ],
)
def test_plan_holds_all_pieces_in_few_sequences(lengths, size, spare):
    counts = histogram(lengths, size)
    groups = cp.plan(counts)
    assert all(sum(l * k for l, k in p) <= size and t > 0 for p, t in groups)
    assert held(groups) == {l: int(n) for l, n in enumerate(counts) if n}
    used, bound = sum(t for _, t in groups), cp.lower_bound(counts)
    assert used <= (500 if spare is None else bound + (spare if spare >= 1 or not spare else spare * bound))


def test_program_covers_no_length_twice():
    counts = histogram(np.random.default_rng(3).geometric(1 / 200, 20000).clip(1, 2048), 2048)
    amounts = cp.solve(counts)
    covered = np.zeros(2049)
    for pattern, amount in amounts.items():
        for length, k in pattern:
            covered[length] += amount * k
    assert (covered <= counts + 1e-6).all()
    # most of the volume is in the program, not in the rounding
    assert covered @ np.arange(2049) >= 0.8 * (counts @ np.arange(2049))


def test_knapsack_equals_plain_loop():
    rng = np.random.default_rng(4)
    price = np.where(rng.random(41) < 0.3, rng.random(41), 0.0)
    price[0] = 0
    best, last = cp.knapsack(price)
    plain = [0.0] * 41
    for room in range(1, 41):
        plain[room] = max([plain[room - 1]] + [plain[room - l] + price[l] for l in range(1, room + 1) if price[l]])
    assert np.allclose(best, plain)


def test_pack_best_fit(spark):
    rng = np.random.default_rng(5)
    words = "packing whole documents into sequences of ids Größe naïve 漢字 <|endoftext|> x1 !".split()
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 900, 60)]
    rows = [(i, t, "s", i) for i, t in enumerate(texts)]
    rows += [(100, None, "s", 0), (101, "", "s", 0), (102, "word " * 30_000, "s", 0), (None, "null id", "s", 1)]
    rows += [(7, texts[7], "s", 7)] * 3 + [(8, "other text of the same id", "s", 1)]
    schema = "doc_id long, text string, piece string, length int"
    path = vocabulary("word_bpe_49k.json")
    docs = spark.createDataFrame(rows, schema).repartition(3)
    got = cp.pack_best_fit(docs, path, 0, 256).collect()
    library = Tokenizer.from_file(path)
    encode = lambda t: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], np.uint32).tobytes()
    want = []
    for doc_id, text, *_ in rows:
        ids = encode(text)
        want += [(doc_id, k, 256 * k, len(p) // 4, zlib.crc32(p), p) for k, at in enumerate(range(0, len(ids), 1024)) for p in [ids[at : at + 1024]]]
    order = lambda r: tuple(map(str, r))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got), key=order) == sorted(want, key=order)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    counts = histogram([w[3] for w in want], 256)
    assert len(sequences) <= cp.lower_bound(counts) + 1
    assert not cp.pack_best_fit(docs.limit(0), path, 0).collect()
