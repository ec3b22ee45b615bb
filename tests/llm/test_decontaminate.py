"""Leak search against alignment of every item with every text."""

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import decontaminate as dc


def brute(item, part):
    """Fewest edits of item against any span of part, by the full table."""
    row = [0] * (len(part) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(part, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edit(rng, text, n):
    chars = list(text)
    for _ in range(n):
        k = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[k] = rng.choice("xyz")
        elif kind == 1:
            chars.insert(k, rng.choice("xyz"))
        elif len(chars) > 1:
            del chars[k]
    return "".join(chars)


@given(st.integers(0, 10**9))
@settings(max_examples=150, deadline=None)
def test_align_is_exact_in_its_band(seed):
    rng = random.Random(seed)
    item = "".join(rng.choice("ab cd") for _ in range(rng.randrange(8, 50)))
    budget = rng.randrange(0, 6)
    inner = edit(rng, item, rng.randrange(0, 8))
    left = "".join(rng.choice("ab cd") for _ in range(rng.randrange(30)))
    part = left + inner + "".join(rng.choice("ab cd") for _ in range(rng.randrange(30)))
    a, b = (np.array([ord(c) for c in s], np.uint32) for s in (item, part))
    got = dc.align(a, b, budget, -len(item), len(part))
    want = brute(item, part)
    assert (got is None) == (want > budget)
    if got:
        assert got[0] == want and brute(item, part[got[1] : got[2]]) == want
        assert abs(got[2] - got[1] - len(item)) <= want


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "an", "in", "on", "re"]) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randrange(12, 50))) for i in range(12)]
    docs, planted = [], set()
    for d in range(120):
        parts = [prose(rng.randrange(5, 80))]
        if d % 3 == 0:
            i = rng.randrange(12)
            budget = int(dc.EDIT_RATE * len(items[i][1]))
            text = edit(rng, items[i][1], rng.randrange(budget + 1))
            if d % 2:
                text = text.upper().replace(" ", "\n\t ")
            parts += [text, prose(rng.randrange(30))]
            planted.add((d, i))
        docs.append((d, " ".join(parts)))
    return items, docs, planted


def frames(spark, items, docs):
    d = spark.createDataFrame([("i", t, 1, i) for i, t in docs], "item_id string, text string, start int, doc_id long")
    return d, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def test_find_leaks(spark):
    items, docs, planted = corpus()
    docs += [(None, "before " + items[0][1] + " after"), (500, None), (501, ""), (502, "word " * 30_000 + items[1][1])]
    docs.append(docs[0])
    extra = [(90, None), (None, "no id but long enough"), (91, "short"), (92, "")]
    for block in (50, 4_000_000):
        got = dc.find_leaks(*frames(spark, items + extra, docs), block_chars=block).collect()
        pairs = {(r.doc_id, r.item_id) for r in got}
        norm = lambda t: " ".join((t or "").lower().split())
        want = {
            (d, i)
            for d, t in docs
            for i, x in items
            if len(t or "") < 5000 and brute(norm(x), norm(t)) <= int(dc.EDIT_RATE * len(norm(x)))
        }
        assert planted <= pairs and pairs == want | {(502, 1)}
        for r in got:
            text, item = dict(docs)[r.doc_id], dict(items)[r.item_id]
            assert brute(norm(item), norm(text[r.start : r.end])) == r.edits
    assert sum(r.doc_id == 0 for r in got) == 2


def test_drop_leaked(spark):
    items, docs, planted = corpus()
    frame, bench = frames(spark, items, docs + [(None, None)])
    kept = dc.drop_leaked(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in planted} | {None}
    assert dc.drop_leaked(frame, bench.filter("false")).count() == len(docs) + 1
    assert not dc.find_leaks(frame.filter("false"), bench).collect()


def test_clustered_edits_at_the_full_budget_beside_short_items():
    """All edits of a long item's match lie in one part of it; short items of the block must hide none of it."""
    rng = random.Random(12)
    letters = "abcdefghijklmnop "
    draw = lambda n: "".join(rng.choice(letters) for _ in range(n)).replace("  ", "ab")
    long = draw(394).strip()
    short = [(k, draw(80)) for k in range(1, 6)]
    for rows in ([(0, long)], [(0, long), *short]):
        items = dc.index_items(rows)
        budget = int(items.budget[items.ids.index(0)])
        for trial in range(20):
            chars = list(long)
            for k in range(budget):
                chars[9 * k + 3] = "#"
            text = f"{draw(300)} {''.join(chars)} {draw(300)}"
            assert any(items.ids[k] == 0 for _, k, *_ in dc.find_items(items, [text])), (len(rows), trial)
