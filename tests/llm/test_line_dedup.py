"""Line dedup against a plain loop."""

import pytest

from tidemark.llm import line_dedup

FOLD = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
LONG = "A line that is Long enough"
ROWS = [
    (3, f"{LONG}\nshort\n{LONG}\nown line of three"),
    (1, f"  {LONG.upper()}\t\nx"),
    (2, f"{LONG.lower()}\nshort\n\n{LONG}\n"),
    (4, None),
    (5, ""),
    (6, "\n\n"),
    (None, f"{LONG}\nnull id"),
    (7, "own line of three"),
    (7, "own line of three"),
    (8, f"\x1cother spaces stay\x1c\n{LONG} \x0b"),
    (9, "\x1cother spaces stay\x1c\nother spaces stay"),
    (10, "\n".join(["repeated in one document only"] * 300)),
    (11, "\n".join(f"{LONG}\nline number {i:05d}" for i in range(3000))),
]


def brute(rows):
    firsts = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(line_dedup.BLANK).translate(FOLD)
            if doc is not None and len(key) >= 10:
                firsts[key] = min(doc, firsts.get(key, doc))
    out = []
    for doc, text in rows:
        parts = (text or "").split("\n")
        keys = [x.strip(line_dedup.BLANK).translate(FOLD) for x in parts]
        stay = [x for x, k in zip(parts, keys) if doc is None or firsts.get(k, doc) == doc]
        out.append((doc, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return out


def frame(spark, rows):
    schema = "text string, key string, doc_id long, runs int, late string, pos int, version string"
    return spark.createDataFrame([(t, "k", d, 1, "l", 2, "v") for d, t in rows], schema)


def test_dedup_lines(spark):
    out = line_dedup.dedup_lines(frame(spark, ROWS))
    assert {"key", "late", "pos", "version"} <= set(out.columns)
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(got, key=order) == sorted(brute(ROWS), key=order)
    assert not line_dedup.dedup_lines(frame(spark, [])).collect()


def test_bitmaps_decode(spark):
    bits = {r.doc_id: r for r in line_dedup.keep_bitmaps(frame(spark, ROWS)).collect()}
    assert set(bits) == {2, 3, 7, 8, 9, 11}
    assert bits[3].runs == [0, 1, 1, 1] and bits[3].n_dropped == 2
    assert len(bits[11].runs) == 6000


def test_hot_line_is_split(spark):
    """One line in every document: no window holds more rows than one salt."""
    rows = [(i, f"the one very common line\nline {i} of its own") for i in range(400)]
    out = line_dedup.dedup_lines(frame(spark, rows))
    assert sorted((r.doc_id, r.n_dropped) for r in out.collect()) == [(i, int(i > 0)) for i in range(400)]


@pytest.mark.parametrize("text", ["only", f"{LONG}"])
def test_plan_is_native(spark, text):
    plan = line_dedup.dedup_lines(frame(spark, [(1, text)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
