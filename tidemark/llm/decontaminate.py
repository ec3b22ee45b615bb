"""Benchmark passages in documents, found by shared character q-grams and verified by banded alignment.

An item of m characters within k edits of a part of a document shares at least m - q + 1 - k q of its q-grams
with it, and these lie on diagonals (position in the document less position in the item) at most k apart.
So q-grams of a document are looked up in an index of the items' q-grams; stretches too poor in hits for any
item are left; hits in the others are counted in overlapping bands of diagonals, each twice the budget wide;
bands that meet their item's bound are verified by an alignment confined to the band.

The items are the query set: blocks of bounded size reach every task, which scans its documents once for each
block. Nothing is shuffled.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a q-gram, and edits allowed for each character of an item.
Q = 8
EDIT_RATE = 0.08
#: Characters of items in one block.
BLOCK_CHARS = 4_000_000
#: Characters of documents scanned at once.
SCAN_CHARS = 2_000_000
TABLE_BITS = 22

MATCHES = "doc_id long, item_id long, start long, end long, edits long, item_chars long"


def _codes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Characters in lower case with white space runs as one space, and their places in ``text``."""
    lowered = text.lower()
    if len(lowered) != len(text):  # a letter whose lower case is longer
        lowered = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    c = np.frombuffer(lowered.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _BLANK[np.minimum(c, 0x3001)]
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    at = np.flatnonzero(keep)
    return np.where(blank[at], np.uint32(32), c[at]), at


#: Fixed by Unicode: white space, all of it below this size.
_BLANK = np.array([chr(c).isspace() for c in range(0x3002)])


def _grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all windows of ``Q`` = 8 characters, by doubling the window three times."""
    h = codes.astype(np.uint32)
    for width, factor in ((1, 0x9E3779B1), (2, 0x85EBCA77), (4, 0xC2B2AE3D)):
        h = h[:-width] * np.uint32(factor) + h[width:] if len(h) > width else h[:0]
    h ^= h >> np.uint32(15)
    return h * np.uint32(0x2C1B3C6D)


@dataclasses.dataclass
class Items:
    """Index of a block of items; those shorter than a q-gram are in none."""

    ids: list[int]
    codes: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    gram: np.ndarray  # sorted hashes, and where each comes from
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    window: int  # every match holds a stretch of this length
    least: int  # with this many hits
    reach: int  # and is no longer than this


def index_items(rows: list[tuple[int, str]], rate: float = EDIT_RATE) -> Items | None:
    ids, codes = [], []
    for item_id, text in rows:
        c, _ = _codes((text or "").strip())
        if len(c) >= Q:
            ids.append(item_id)
            codes.append(c)
    if not ids:
        return None
    size = np.array([len(c) for c in codes])
    # no more edits than leave one q-gram to count
    budget = np.minimum((rate * size).astype(int), (size - Q) // Q)
    bound = size - Q + 1 - budget * Q
    grams = [_grams(c) for c in codes]
    gram = np.concatenate(grams)
    order = np.argsort(gram, kind="stable")
    table = np.zeros(1 << TABLE_BITS, bool)
    table[gram >> np.uint32(32 - TABLE_BITS)] = True
    reach = size + budget
    window = int(reach.min())
    # a match of a longer item fills several stretches, one of them with its share of the hits
    least = int(np.ceil(bound / np.ceil(reach / window)).min())
    return Items(
        ids,
        codes,
        budget,
        bound,
        gram[order],
        np.repeat(np.arange(len(ids)), [len(g) for g in grams])[order],
        np.concatenate([np.arange(len(g)) for g in grams])[order],
        table,
        window,
        max(1, least),
        int(reach.max()),
    )


def _rich(hit: np.ndarray, window: int, least: int, reach: int) -> np.ndarray:
    """Hits in reach of some window that holds at least ``least`` of them.

    A match holds such a window and is no longer than ``reach``, so none of its hits is left out, whatever
    other items stand in the block.
    """
    at = np.flatnonzero(hit)
    if len(at) < least:
        return at[:0]
    close = at[least - 1 :] - at[: len(at) - least + 1] < window
    cover = np.zeros(len(at) + 1, np.int64)
    first = np.flatnonzero(close)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + least, -1)
    rich = at[np.cumsum(cover[:-1]) > 0]
    if not len(rich):
        return rich
    after = np.searchsorted(rich, at)
    far = np.minimum(
        np.abs(at - rich[np.maximum(after - 1, 0)]), np.abs(rich[np.minimum(after, len(rich) - 1)] - at)
    )
    return at[far <= reach]


def align(item: np.ndarray, part: np.ndarray, budget: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Fewest edits of ``item`` against any span of ``part`` on diagonals ``low`` to ``high``.

    (edits, start, end) of the span, leftmost end first among equals, or None above ``budget``.
    """
    low, high = low - budget, high + budget
    width = high - low + 1
    big = budget + 1
    offset = np.arange(width)
    # row i holds columns i + low .. i + high; a free start anywhere in the part
    column = low + offset
    cost = np.where((column >= 0) & (column <= len(part)), 0, big).astype(np.int32)
    begin = column.astype(np.int64)
    padded = np.concatenate([np.full(max(0, -low), -1, np.int64), part.astype(np.int64)])
    shift = max(0, -low)
    padded = np.concatenate([padded, np.full(max(0, len(item) + high + shift + 1 - len(padded)), -2, np.int64)])
    for i in range(1, len(item) + 1):
        column = i + low + offset
        seen = padded[i + low - 1 + shift : i + low - 1 + shift + width] if i + low - 1 + shift >= 0 else None
        if seen is None:
            seen = np.full(width, -1, np.int64)
            seen[1:] = padded[: width - 1]
        same = cost + (seen != item[i - 1])
        up = np.append(cost[1:] + 1, big)
        best = np.minimum(same, up)
        start = np.where(same <= up, begin, np.append(begin[1:], 0))
        best = np.where((column < 0) | (column > len(part)), big + width, best)
        # runs of extra characters of the part: the least of best[j] + (x - j) over j <= x
        key = (best - offset) * (width + 1) + offset
        run = np.minimum.accumulate(key)
        source = run % (width + 1)
        cost = np.minimum(run // (width + 1) + offset, big).astype(np.int32)
        begin = start[source]
        if cost.min() > budget:
            return None
    k = int(np.argmin(cost))
    if cost[k] > budget:
        return None
    return int(cost[k]), int(begin[k]), int(len(item) + low + k)


def find_items(items: Items, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of all items in all texts, the best of overlapping spans of an item."""
    pairs = [_codes(t) for t in texts]
    sizes = np.array([len(c) for c, _ in pairs])
    # texts in a row, with a character between them that no q-gram of an item holds
    codes = np.concatenate([x for c, _ in pairs for x in (c, np.array([0x110000], np.uint32))])
    starts = np.cumsum(sizes + 1) - sizes - 1
    h = _grams(codes)
    at = _rich(items.table[h >> np.uint32(32 - TABLE_BITS)], items.window, items.least, items.reach)
    lo = np.searchsorted(items.gram, h[at], "left")
    n = np.searchsorted(items.gram, h[at], "right") - lo
    at, lo, n = at[n > 0], lo[n > 0], n[n > 0]
    if not len(at):
        return []
    entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at = np.repeat(at, n)
    item, diagonal = items.item[entry], at - items.place[entry] + len(codes)
    step = items.budget[item] + 1
    bands = np.concatenate([diagonal // step, diagonal // step - 1])
    span = 2 * len(codes) + 2
    keys, counts = np.unique(np.concatenate([item, item]) * span + bands, return_counts=True)
    keys = keys[counts >= items.bound[keys // span]]
    found: dict[tuple[int, int], list] = {}
    for key in keys.tolist():
        k, band = divmod(key, span)
        step = int(items.budget[k]) + 1
        low = band * step - len(codes)
        middle = min(max(low + step + len(items.codes[k]) // 2, 0), len(codes) - 1)
        t = int(np.searchsorted(starts, middle, "right")) - 1
        for text in {max(t - 1, 0), t, min(t + 1, len(texts) - 1)}:
            base = int(starts[text])
            left, right = low - base, low - base + 2 * step - 1
            budget = int(items.budget[k])
            # the window of the text that the band can reach
            a = max(0, left - budget)
            b = min(int(sizes[text]), right + budget + len(items.codes[k]))
            if a >= b:
                continue
            got = align(items.codes[k], pairs[text][0][a:b], budget, left - a, right - a)
            if got:
                edits, x, y = got
                found.setdefault((text, k), []).append((edits, a + x, a + y))
    out = []
    for (text, k), spans in found.items():
        taken: list[tuple[int, int]] = []
        for edits, x, y in sorted(set(spans)):
            if all(y <= p or x >= q for p, q in taken):
                taken.append((x, y))
                place = pairs[text][1]
                out.append((text, k, int(place[x]), int(place[y - 1]) + 1, edits))
    return sorted(out)


def _item_blocks(benchmark: DataFrame, chars: int):
    """Lists of (item_id, text) of about ``chars`` characters; only one is held at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        if r.item_id is not None and r.text:
            held.append((r.item_id, r.text))
            size += len(r.text)
            if size >= chars:
                yield held
                held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per benchmark passage found in a document: ids, character span there, edits, item length.

    Case and the kind and amount of white space do not count. An item matches with at most ``rate`` edits a
    character (fewer for items so short that no q-gram would be left); items of under 8 characters, null
    items and items without id match nothing. Documents with null text match nothing; a null doc_id is kept;
    repeated rows give repeated matches; extra columns are ignored. Texts of any length are scanned whole.
    """
    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], MATCHES)
    for rows in _item_blocks(benchmark, block_chars):
        out = out.union(picked.mapInPandas(_scanner(rows, rate), MATCHES))
    return out


def _scanner(rows, rate):
    built: list = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not built:
            built.append(index_items(rows, rate))
        items = built[0]
        for batch in batches:
            found, ids, texts, size = [], [], [], 0

            def flush():
                if texts and items:
                    for t, k, start, end, edits in find_items(items, texts):
                        found.append((ids[t], items.ids[k], start, end, edits, len(items.codes[k])))

            for doc_id, text in zip(batch["doc_id"].astype("Int64").tolist(), batch["text"]):
                if text:
                    ids.append(doc_id)
                    texts.append(text)
                    size += len(text)
                if size >= SCAN_CHARS:
                    flush()
                    ids, texts, size = [], [], 0
            flush()
            yield pd.DataFrame(found, columns=["doc_id", "item_id", "start", "end", "edits", "item_chars"]).astype(
                {"doc_id": "Int64"}
            )

    return run


def drop_leaked(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark passage; rows with a null doc_id stay.

    Each row is decided where it is read, with all its columns as they are, so no text is shuffled.
    """
    for rows in _item_blocks(benchmark, block_chars):
        docs = docs.mapInArrow(_sieve(rows, rate), docs.schema)
    return docs


def _sieve(rows, rate):
    built: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(index_items(rows, rate))
        items = built[0]
        for batch in batches:
            clean = np.ones(len(batch), bool)
            held, size = [], 0
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for k, text in enumerate(texts):
                if items and text and ids[k].is_valid:
                    held.append(k)
                    size += len(text)
                if held and (size >= SCAN_CHARS or k + 1 == len(texts)):
                    for t, *_ in find_items(items, [texts[i] for i in held]):
                        clean[held[t]] = False
                    held, size = [], 0
            yield batch.filter(pa.array(clean))

    return run
