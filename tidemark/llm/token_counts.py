"""Token counts of documents without their token ids.

A task tallies the pre-tokens of a block of documents. Those that many documents of the block hold are counted
by the vocabulary right there (a worker asks once and remembers) and go into the documents' sums before anything
moves. The others travel packed by hash bucket: the pre-tokens of one block and bucket, which of the block's
documents hold each, and how often. A bucket holds every other occurrence of its pre-tokens, so each distinct
one is counted once there and joined to its frequencies; a task adds these up per document over all its buckets
and sends the sums back to the block, where the document ids wait.

So no pre-token, however frequent, fills a bucket: it has a bounded number of entries a block. Blocks are made
from the rows in scan order: ``docs`` should be a stored table, so that a task that is run again makes the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.vocab import encoder

#: Characters and documents of a block, whichever comes first (positions there are 16 bits).
BLOCK_CHARS = 32_000_000
BLOCK_DOCS = 60_000
#: Documents of a block up to which a pre-token travels; hash buckets for each shuffle partition.
FEW = 64
BUCKETS = 32
#: Blocks a task sums at once.
OPEN_BLOCKS = 64

#: ``words``: the pre-tokens, each behind its length in bytes; ``sizes``, ``docs``, ``freqs``: entries of each,
#: their documents and frequencies; all compressed. ``info`` is set in a block's own row only: ids, whether they
#: are set, bytes and tokens so far of its documents.
PACKED = "bucket long, block long, words binary, sizes binary, docs binary, freqs binary, info binary"
SUMS = "block long, at binary, n binary, info binary"
PACKED_SCHEMA = pa.schema(
    [("bucket", pa.int64()), ("block", pa.int64())]
    + [(c, pa.binary()) for c in ("words", "sizes", "docs", "freqs", "info")]
)
SUMS_SCHEMA = pa.schema([("block", pa.int64())] + [(c, pa.binary()) for c in ("at", "n", "info")])


def _blocks(batches: Iterator[pa.RecordBatch], chars: int):
    """Lists of (doc_id, text, bytes) of about ``chars`` characters, never empty."""
    held, size = [], 0
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
        for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), n):
            held.append(row)
            size += row[2]
            if size >= chars or len(held) >= BLOCK_DOCS:
                yield held
                held, size = [], 0
    if held:
        yield held


def _packed(docs: DataFrame, path: str, chars: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        press = zstandard.ZstdCompressor(level=1).compress
        base = TaskContext.get().partitionId() << 32
        for k, held in enumerate(_blocks(batches, chars)):
            tallies, marks = enc.tally(text for _, text, _ in held)
            codes: dict[str, int] = {}
            code = np.fromiter((codes.setdefault(w, len(codes)) for t in tallies for w in t), np.int32)
            freq = np.fromiter((n for t in tallies for n in t.values()), np.int64)
            doc = np.repeat(np.arange(len(held)), [len(t) for t in tallies])
            del tallies
            words = list(codes)
            total = np.array(marks, np.int64)
            often = np.bincount(code, minlength=len(words)) > FEW
            if often.any():
                pieces = np.zeros(len(words), np.int64)
                at = np.flatnonzero(often)
                pieces[at] = enc.counts([words[i] for i in at])
                here = often[code]
                total += np.bincount(doc[here], pieces[code[here]] * freq[here], len(held)).astype(np.int64)
                code, freq, doc = code[~here], freq[~here], doc[~here]
            own = [[r[0] or 0 for r in held], [r[0] is not None for r in held], [r[2] for r in held], total]
            row = {"bucket": (base + k) % buckets, "block": base + k, "info": np.array(own, np.int64).tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema=PACKED_SCHEMA)
            # a frequency over 255 takes several entries
            times = (freq + 254) // 255
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            code, doc, freq = (np.repeat(x, times) for x in (code, doc, freq))
            freq = np.minimum(freq - 255 * nth, 255).astype(np.uint8)
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((code, bucket[code]))
            code, doc, freq = code[order], doc[order].astype(np.uint16), freq[order]
            first = np.flatnonzero(np.diff(code, prepend=-1))
            sizes = np.diff(np.append(first, len(code))).astype(np.uint32)
            seen = code[first]
            turn = np.flatnonzero(np.diff(bucket[seen], prepend=-1))
            edges = np.append(first, len(code))
            rows = []
            for a, b in zip(turn.tolist(), np.append(turn[1:], len(seen)).tolist()):
                x, y = edges[a], edges[b]
                parts = [words[i].encode() for i in seen[a:b]]
                lengths = np.array([len(p) for p in parts], np.uint32).tobytes()
                rows.append(
                    {
                        "bucket": int(bucket[seen[a]]),
                        "block": base + k,
                        "words": press(np.uint32(len(parts)).tobytes() + lengths + b"".join(parts)),
                        "sizes": press(sizes[a:b].tobytes()),
                        "docs": press(doc[x:y].tobytes()),
                        "freqs": press(freq[x:y].tobytes()),
                    }
                )
                if len(rows) == 1_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=PACKED_SCHEMA)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=PACKED_SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PACKED)


def _unpacked(raw: bytes) -> list[str]:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = 4 * (n + 1) + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)
    return [raw[a:b].decode() for a, b in zip([4 * (n + 1), *ends[:-1].tolist()], ends.tolist())]


def _sums(packed: DataFrame, path: str) -> DataFrame:
    """Per task and block: tokens of each document from the buckets of the task; block rows pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        open_ = zstandard.ZstdDecompressor().decompress
        sums: dict[int, np.ndarray] = {}
        held: list[dict] = []

        def settle():
            """Count the distinct pre-tokens of one bucket and add up."""
            lists = [_unpacked(open_(r["words"])) for r in held]
            distinct = list({w for ws in lists for w in ws})
            pieces = dict(zip(distinct, enc.counts(distinct)))
            for r, ws in zip(held, lists):
                n = np.fromiter(map(pieces.__getitem__, ws), np.int64, len(ws))
                n = np.repeat(n, np.frombuffer(open_(r["sizes"]), np.uint32))
                n = n * np.frombuffer(open_(r["freqs"]), np.uint8)
                found = np.bincount(np.frombuffer(open_(r["docs"]), np.uint16), n).astype(np.int64)
                total = sums.get(r["block"])
                if total is None or len(total) < len(found):
                    sums[r["block"]] = found if total is None else found + np.pad(total, (0, len(found) - len(total)))
                else:
                    total[: len(found)] += found
            held.clear()

        def flush():
            rows = []
            for block, total in sums.items():
                at = np.flatnonzero(total).astype(np.uint16)
                rows.append({"block": block, "at": at.tobytes(), "n": total[at].astype(np.uint32).tobytes()})
            sums.clear()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=SUMS_SCHEMA)

        for batch in batches:
            for r in batch.to_pylist():
                if r["info"] is not None:
                    row = {"block": r["block"], "info": r["info"]}
                    yield pa.RecordBatch.from_pylist([row], schema=SUMS_SCHEMA)
                    continue
                if held and held[0]["bucket"] != r["bucket"]:
                    settle()
                    if len(sums) > OPEN_BLOCKS:
                        yield from flush()
                held.append(r)
        if held:
            settle()
        yield from flush()

    return packed.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, SUMS)


def count_tokens(docs: DataFrame, path: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` of every row of ``docs`` (columns ``doc_id``, ``text``).

    Null text counts as empty (no tokens); rows with a null or repeated doc_id are counted each; extra
    columns are ignored; an empty table gives no rows. A special string inside a text is one token.
    """
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sums = _sums(_packed(docs, path, block_chars, buckets), path)

    def finish(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        (own,) = [r["info"] for r in rows if r["info"] is not None]
        ids, given, n_bytes, so_far = np.frombuffer(own, np.int64).reshape(4, -1)
        total = so_far.copy()
        for r in rows:
            if r["info"] is None:
                total[np.frombuffer(r["at"], np.uint16)] += np.frombuffer(r["n"], np.uint32)
        return pa.table(
            {
                "doc_id": pa.array(ids, pa.int64(), mask=given == 0),
                "n_bytes": pa.array(n_bytes),
                "n_tokens": pa.array(total),
            }
        )

    return sums.groupBy("block").applyInArrow(finish, "doc_id long, n_bytes long, n_tokens long")
