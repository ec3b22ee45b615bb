"""Best-fit packing of documents into few sequences by a configuration linear program.

Only the histogram of piece lengths (at most one count per length) reaches the driver. There a configuration
is a multiset of lengths that fits in a sequence, and the program asks for the fewest configurations that
cover all counts. It is solved by multiplicative weights: a length's price is its share of a sequence, raised
exponentially the further it lags behind; a knapsack dynamic program over the prices gives for every length
the best configuration that holds it; each is used as far as the lengths in it are behind the goal of the
phase. The solution is rounded down, solved once more for what is left, and the last pieces go to the
sequence with the tightest gap. So near all sequences are full, at any size of input.

Pieces find their place without a sort: a piece's number among those of its length is its number in its own
task plus the counts of earlier tasks, and the plan is a table of ranges of such numbers.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.vocab import encoder
from tidemark.session import durable

#: Goals on the way to full coverage, and most pricing rounds for each.
PHASES, ROUNDS = 4, 40
#: Growth of a price per goal that its length is behind; spread of the choice among near-equal fillings.
RATE, SPREAD = 0.1, 0.02
#: Unused shares of a configuration that the program accepts in turn, against the fullest one there is.
SLACK = (0.0004, 0.002, 0.01, 0.05)
#: Rows of an output batch.
BATCH = 20_000

Pattern = tuple[tuple[int, int], ...]  # (length, pieces), ascending


def knapsack(price: np.ndarray, luck: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Value of the best filling of every capacity, and a piece of it (0: one token stays empty).

    ``price[l]`` is that of one piece of length l, 0 where there is none. ``luck`` (factors just below 1)
    spreads the choice among fillings of nearly the same value.
    """
    size = len(price) - 1
    best, last = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for room in range(1, size + 1):
        values = price[1 : room + 1] + best[room - 1 :: -1]
        k = int((values if luck is None else values * luck[7 * room % size : 7 * room % size + room]).argmax())
        if price[k + 1] > 0 and values[k] > best[room - 1]:
            best[room], last[room] = values[k], k + 1
        else:
            best[room] = best[room - 1]
    return best, last


def _filling(first: int, last: np.ndarray) -> Counter:
    """The best configuration that holds a piece of length ``first``."""
    pieces = Counter({first: 1})
    room = len(last) - 1 - first
    while room > 0 and last[room]:
        pieces[int(last[room])] += 1
        room -= int(last[room])
    return pieces


def solve(counts: np.ndarray) -> dict[Pattern, float]:
    """Amounts of configurations that cover most of ``counts`` (pieces by length) and exceed none."""
    size = len(counts) - 1
    rng = np.random.default_rng(0)
    present = counts > 0
    share = np.arange(size + 1) / size
    full, _ = knapsack(np.where(present, share, 0.0))
    bars = [(1 - s) * full[size] * size for s in SLACK]
    covered = np.zeros(size + 1)
    amounts: dict[Pattern, float] = defaultdict(float)
    for phase in range(1, PHASES + 1):
        goal = phase / PHASES
        step = 0
        for _ in range(ROUNDS):
            behind = np.where(present, (goal - covered) * PHASES, 0.0)
            open_ = behind > 1e-9
            if not open_.any():
                break
            price = np.where(open_, share * np.exp(RATE * np.minimum(behind, 5)), 0.0)
            _, last = knapsack(price, 1 - SPREAD * rng.random(2 * size))
            budget = np.where(open_, (goal - covered) * counts, 0.0)
            gained = 0.0
            for first in np.argsort(-behind * share, kind="stable")[: int(open_.sum())].tolist():
                if budget[first] <= 1e-9 * counts[first]:
                    continue
                pieces = _filling(first, last)
                if sum(l * k for l, k in pieces.items()) < bars[step]:
                    continue
                amount = min(budget[l] / k for l, k in pieces.items())
                if amount <= 0:
                    continue
                for l, k in pieces.items():
                    budget[l] -= amount * k
                    covered[l] += amount * k / counts[l]
                amounts[tuple(sorted(pieces.items()))] += amount
                gained += amount
            if gained * PHASES < 0.002 * (share @ counts):
                step += 1
                if step == len(bars):
                    break
    return amounts


def plan(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Configurations and how many sequences use each; together they hold exactly ``counts`` pieces by length."""
    size = len(counts) - 1
    left = counts.astype(np.int64).copy()
    waiting: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)  # by gap
    for part in (0.0, 0.5):  # round down, then to the nearest as far as pieces remain
        if not left.any():
            break
        for pattern, amount in sorted(solve(left).items(), key=lambda x: (-x[1], x[0])):
            times = min(math.floor(amount + part), *(int(left[l]) // k for l, k in pattern))
            if times:
                for l, k in pattern:
                    left[l] -= times * k
                waiting[size - sum(l * k for l, k in pattern)].append((pattern, times))
    for length in np.flatnonzero(left)[::-1].tolist():
        _best_fit(waiting, length, int(left[length]), size)
    return [group for groups in waiting.values() for group in groups]


def _best_fit(waiting, length: int, n: int, size: int) -> None:
    """Put ``n`` pieces of one length into the tightest gaps, new sequences last."""
    while n:
        gap = min((g for g, groups in waiting.items() if g >= length and groups), default=None)
        if gap is None:
            waiting[size].append(((), -(-n // (size // length))))
            gap = size
        pattern, times = waiting[gap].pop()
        fit = gap // length
        whole = min(times, n // fit)
        if whole:
            waiting[gap - fit * length].append((_with(pattern, length, fit), whole))
            n, times = n - whole * fit, times - whole
        if n and times:
            some = min(n, fit)
            waiting[gap - some * length].append((_with(pattern, length, some), 1))
            n, times = n - some, times - 1
        if times:
            waiting[gap].append((pattern, times))


def _with(pattern: Pattern, length: int, k: int) -> Pattern:
    pieces = Counter(dict(pattern))
    pieces[length] += k
    return tuple(sorted(pieces.items()))


def lower_bound(counts: np.ndarray) -> int:
    """Sequences that no packing can do without: by volume, and by pieces over half a sequence."""
    size = len(counts) - 1
    volume = -(-int(counts @ np.arange(size + 1)) // size)
    return max(volume, int(counts[size // 2 + 1 :].sum()))


class _Ranges:
    """The plan as ranges of piece numbers of each length, looked up by binary search."""

    def __init__(self, groups: list[tuple[Pattern, int]]):
        seen: Counter = Counter()
        rows, sequence = [], 0
        for pattern, times in groups:
            offset = 0
            for length, k in pattern:
                rows.append((length, seen[length], k, sequence, offset))
                seen[length] += times * k
                offset += length * k
            sequence += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.length, self.first, self.k, self.sequence, self.offset = np.ascontiguousarray(table.T)
        self.key = (self.length << 44) + self.first

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 44) + number, "right") - 1
        inside = number - self.first[at]
        return self.sequence[at] + inside // self.k[at], self.offset[at] + inside % self.k[at] * length


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, _part int, _nth long"
)
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


def cut_documents(docs: DataFrame, path: str, end_id: int, size: int, keep_ids: bool) -> DataFrame:
    """Pieces of at most ``size`` ids, numbered in their task among those of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.uint32(end_id).tobytes()
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()
        rows: list[tuple] = []

        def batch_of(some):
            columns = zip(*some) if some else [[]] * len(_TYPES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc.encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    some = ids[at : at + 4 * size]
                    length = len(some) // 4
                    kept = some if keep_ids else None
                    rows.append((doc_id, piece, at // 4, length, zlib.crc32(some), kept, part, seen[length]))
                    seen[length] += 1
                    if len(rows) >= BATCH:
                        yield batch_of(rows)
                        rows = []
        yield batch_of(rows)

    picked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return picked.mapInArrow(run, PIECES)


def pack_best_fit(docs: DataFrame, path: str, end_id: int, size: int = 2048, keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents (columns ``doc_id``, ``text``) in as few sequences of ``size`` ids as the plan finds.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, ids`` (little-endian unsigned 32-bit),
    ``sequence_id, offset``. Only documents longer than ``size`` are cut, into pieces of that size and a last
    shorter one. Null text counts as empty (only the end id); null and repeated ids are kept, each row packed
    on its own; extra columns are ignored; an empty table gives no rows. Texts of any length are packed whole.
    """
    pieces = durable(cut_documents(docs, path, end_id, size, keep_ids))
    sizes = durable(pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")))
    counts = np.zeros(size + 1, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    ranges = _Ranges(plan(counts))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "_number"))
            sequence, offset = ranges.place(length, number)
            arrays = [*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    numbered = pieces.join(starts, ["length", "_part"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    numbered = numbered.select(*columns, (F.col("_start") + F.col("_nth")).alias("_number"))
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"
    return numbered.mapInArrow(run, ddl)
