"""Token ids as ORC files in document order.

The files hold one row per document: its id, its ids (integers, which ORC keeps run-length encoded), the
file part it is in and its start there. Row indexes and a Bloom filter on the document id let a reader skip
stripes; a scan reads stripes in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.vocab import encoder

#: Rows between entries of the row index, and bytes of a stripe.
INDEX_ROWS = 1_000
STRIPE_BYTES = 16 << 20
#: Bytes of text of an Arrow batch that leaves a task, give or take one document.
BATCH_BYTES = 4 << 20

STORED = "doc_id long, ids array<int>, n_tokens long, part int, part_start long"


def _batches(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``BATCH_BYTES`` of text (second column)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // BATCH_BYTES)) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows] if batch.num_rows else []
    for a, b in zip(bounds, bounds[1:]):
        yield batch.slice(a, b - a)


def encode_ordered(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Ids of every document (columns ``doc_id``, ``text``) in ranges of ascending doc_id.

    Each task streams one sorted range and counts the ids before each document. Rows of one doc_id stay
    together, ordered by text. Null text counts as empty, null doc_id comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = np.uint32(end_id).tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            for some in _batches(batch):
                ids = [x + end for x in enc.encode_all(some.column(1).to_pylist())]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(n)
                flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.ListArray.from_arrays(offsets, flat),
                        pa.array(n),
                        pa.array(np.full(len(ids), part, np.int32)),
                        pa.array(start + ends - n),
                    ],
                    names=["doc_id", "ids", "n_tokens", "part", "part_start"],
                )
                start += int(ends[-1])

    ranged = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return ranged.mapInArrow(run, STORED)


def write_tokens(docs: DataFrame, target: str, path: str, end_id: int) -> None:
    """Write the ids of all documents as ORC files below ``target``, in ascending doc_id order.

    Extra columns are ignored, repeated documents are kept, an empty table gives an empty folder with its
    schema. Texts of any length are written whole.
    """
    (
        encode_ordered(docs, path, end_id)
        .write.format("orc")
        .option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .save(target)
    )


def read_tokens(spark: SparkSession, target: str, condition: Column | None = None) -> DataFrame:
    """Stored documents with ``start``, the number of ids of all documents before each.

    A ``condition`` on doc_id reaches the ORC scan and prunes stripes. The part totals are one row a file, of
    which there are as many as shuffle partitions, and so are sent to all tasks.
    """
    stored = spark.read.schema(STORED).orc(target)
    totals = stored.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    picked = stored if condition is None else stored.filter(condition)
    return picked.join(F.broadcast(starts), "part").select(
        "doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids"
    )


def with_crc32(stored: DataFrame) -> DataFrame:
    """Adds ``ids_crc32`` of the ids as little-endian unsigned 32-bit integers, drops the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.uint32)
            ends = np.cumsum(batch.column(2).to_numpy())
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(np.r_[0, ends[:-1]], ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return stored.select("doc_id", "start", "n_tokens", "ids").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )
