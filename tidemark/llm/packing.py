"""Hierarchical packing of documents into token sequences of several context sizes.

A document's ids (with its end id) are cut into whole long windows; the rest is routed to the smallest
tier that holds it. Windows are opened from the longest tier down, and the gap a piece leaves is filled
with the longest waiting piece that fits, so shorter tiers fill longer windows. Where no waiting piece
fits whole, one is cut to the gap. So every window but the last of a task is full. Full windows are dealt
to step groups of equal token totals, longest first.

Everything happens in the task that read the documents, block by block: nothing is shuffled, memory is
bounded by a block, and a re-run of a lost task gives the same sequences when its input is a stored table.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.vocab import encoder

#: Context sizes, powers of two; a shorter window is a sequence of that length, without padding.
TIERS = (256, 512, 1024, 2048)
#: Tokens a task holds before it packs them.
BLOCK_TOKENS = 2_000_000
#: Tokens of a training step group.
STEP_TOKENS = 32_768

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("tier", T.LongType()),
        T.StructField("step_group", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


class _Pool:
    """Waiting pieces by length; the lengths present are the set bits of one integer."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.present = 0

    def add(self, length: int, piece: tuple) -> None:
        self.by_length.setdefault(length, []).append(piece)
        self.present |= 1 << length

    def longest(self, limit: int) -> int:
        """Longest length up to ``limit``, 0 if none."""
        return max(0, (self.present & ((2 << limit) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.present & -self.present).bit_length() - 1

    def take(self, length: int) -> tuple:
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            self.present ^= 1 << length
        return piece


def pack(lengths, tiers=TIERS, last: bool = True):
    """Windows for documents of the given lengths, and what is left over.

    A window is (tier, [(document, start, length), ...]) with pieces from offset 0 on. Without ``last``,
    pieces that fill no window are returned instead of a last padded window.
    """
    tiers = sorted(tiers)
    top = tiers[-1]
    windows, pool = [], _Pool()
    for doc, (at, n) in enumerate(lengths):
        while n >= top:
            windows.append((top, [(doc, at, top)]))
            at, n = at + top, n - top
        if n:
            pool.add(n, (doc, at))
    while pool.present:
        length = pool.longest(top)
        tier = next(t for t in tiers if t >= length)
        doc, at = pool.take(length)
        window, gap = [(doc, at, length)], tier - length
        while gap and pool.present:
            if length := pool.longest(gap):
                doc, at = pool.take(length)
                window.append((doc, at, length))
                gap -= length
            else:
                length = pool.shortest()
                doc, at = pool.take(length)
                window.append((doc, at, gap))
                pool.add(length - gap, (doc, at + gap))
                gap = 0
        if not gap:
            windows.append((tier, window))
            continue
        # only the last window of a block gets here: whole smaller tiers first
        rest = window
        for t in reversed(tiers):
            while sum(x[2] for x in rest) >= t:
                full, rest = _cut(rest, t)
                windows.append((t, full))
        if last and rest:
            windows.append((top, rest))
            rest = []
        return windows, rest
    return windows, []


def _cut(pieces, size):
    """The first ``size`` tokens of the pieces, and the others."""
    head, tail, left = [], [], size
    for doc, at, n in pieces:
        k = min(n, left)
        if k:
            head.append((doc, at, k))
        if n > k:
            tail.append((doc, at + k, n - k))
        left -= k
    return head, tail


def deal_steps(windows, step_tokens: int) -> list[int]:
    """Step group of each window: longest first, each to the group with the fewest tokens so far."""
    total = sum(t for t, _ in windows)
    heap = [(0, g) for g in range(max(1, round(total / step_tokens)))]
    groups = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: -windows[k][0]):
        load, g = heapq.heappop(heap)
        groups[k] = g
        heapq.heappush(heap, (load + windows[k][0], g))
    return groups


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int,
    tiers=TIERS,
    block_tokens: int = BLOCK_TOKENS,
    step_tokens: int = STEP_TOKENS,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents (columns ``doc_id``, ``text``) in sequences of the given sizes.

    One row per piece: its document, place and ids (little-endian unsigned 32-bit), their crc32, its sequence
    and offset there, the sequence's tier and its step group (of one block of a task). ``docs`` should be a
    stored table, so that a task that is run again reads the same rows.

    Null text counts as empty (only the end id); a null doc_id is kept; repeated documents are packed each;
    extra columns are ignored; an empty table gives no rows. Texts of any length are packed whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.uint32(end_id).tobytes()
        base = TaskContext.get().partitionId() << 32
        sequences = groups = 0
        held, tokens = [], 0

        def flush(last: bool):
            nonlocal held, tokens, sequences, groups
            windows, rest = pack([(at, len(ids) // 4 - at) for _, ids, at in held], tiers, last)
            dealt = deal_steps(windows, step_tokens)
            rows = {name: [] for name in PIECES.fieldNames()}
            for (tier, pieces), group in zip(windows, dealt):
                offset = 0
                for doc, at, n in pieces:
                    doc_id, ids, _ = held[doc]
                    part = ids[4 * at : 4 * (at + n)]
                    for name, value in zip(
                        rows,
                        (doc_id, at, n, zlib.crc32(part), len(ids) // 4, base + sequences, offset)
                        + (tier, base + groups + group, part if keep_ids else None),
                    ):
                        rows[name].append(value)
                    offset += n
                sequences += 1
            groups += max(dealt, default=-1) + 1
            # a document that is cut keeps what is left of it for the next block
            held = [(held[doc][0], held[doc][1], at) for doc, at, _ in rest]
            tokens = sum(n for _, _, n in rest)
            for k in range(0, len(rows["doc_id"]), 20_000):
                some = [pa.array(v[k : k + 20_000], _arrow(f)) for v, f in zip(rows.values(), PIECES)]
                yield pa.RecordBatch.from_arrays(some, names=list(rows))

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                held.append((doc_id, ids, 0))
                tokens += len(ids) // 4
                if tokens >= block_tokens:
                    yield from flush(False)
        yield from flush(True)

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, PIECES)


def _arrow(field: T.StructField) -> pa.DataType:
    return pa.binary() if isinstance(field.dataType, T.BinaryType) else pa.int64()
