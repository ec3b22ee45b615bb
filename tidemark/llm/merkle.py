"""Merkle manifest of a dataset: one digest per row, one per group and one for all, with proofs.

Leaf places come from bitmaps, not from a sort: the ids of a group are merged into bitmaps of 4,096 ids, cut
to the bytes in use, under a popcount directory of two levels; the place of an id is the directory's count
plus the bits before it. Places key the slots of packed arrays of 4,096 nodes. One task reduces an array by
four levels of eight, so each round shrinks a tree by 4,096 and only digests move. A second way down hands
every array the runs above it, from which its rows' proofs follow.

All digests are sha256; inner ones hash the joined hexadecimal text of their run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable

#: Children of an inner node.
FANOUT = 8
#: Levels that one packed array spans, and bits of its slots.
LEVELS = 4
SLOT_BITS = 12
SLOTS = 1 << SLOT_BITS
#: Bits of an id inside its bitmap, and of a bitmap inside its directory block.
MAP_BITS = 12
BLOCK_BITS = 10

NODES = "grp string, idx long, n long, digest binary"
PROVEN = (
    "doc_id long, grp string, leaf string, subroot string, root string, "
    "proof_sha256 string, folded_root string, verified boolean"
)


def leaf_digest(fields: Sequence[str | Column]) -> Column:
    """sha256 over the fields: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    parts = []
    for f in fields:
        text = (F.col(f) if isinstance(f, str) else f).cast("string")
        parts.append(F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _bits_before(byte: Column) -> Column:
    """Number of bits of the bitmap that stand before ``_pos``, which lies in its byte ``byte``."""
    last = F.conv(F.hex(F.substring("_bits", byte + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.expr("shiftleft(1, cast(_pos % 8 as int)) - 1")
    return F.bitmap_count(F.substring("_bits", F.lit(1), byte)) + F.bit_count(last.bitwiseAND(mask))


def _sorted_places(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``_place`` from 0 on in the order of the columns, dealt by ranges of them."""
    cut = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = durable(cut.withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = cut.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_k"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut.withColumn("_part", part).join(starts, "_part")
    return placed.withColumn("_place", F.col("_start") + inside).drop("_m", "_part", "_start")


def bitmaps(leaves: DataFrame) -> DataFrame:
    """Bitmaps of the ids of each group, cut to the bytes in use, with their directory counts.

    Columns: ``grp, _map`` (upper bits of the ids), ``_bits`` from byte ``_first`` on, ``_n`` rows, ``_before``
    rows of the group with smaller ids (null ids come first), ``_repeats`` (place in the map and further rows
    of ids that occur more than once, null if there are none).
    """
    ids = leaves.filter("doc_id is not null")
    maps = ids.groupBy("grp", "_map").agg(
        F.bitmap_construct_agg("_pos").alias("_all"),
        F.min("_pos").alias("_lo"),
        F.max("_pos").alias("_hi"),
        F.count(F.lit(1)).alias("_n"),
    )
    first, last = (F.floor(F.col(c) / 8).cast("int") for c in ("_lo", "_hi"))
    maps = durable(
        maps.select(
            "grp",
            "_map",
            F.shiftright("_map", BLOCK_BITS).alias("_block"),
            first.alias("_first"),
            F.substring("_all", first + 1, last - first + 1).alias("_bits"),
            "_n",
            (F.col("_n") - F.bitmap_count("_all")).alias("_more"),
        )
    )
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("grp", "_block").orderBy("_map").rowsBetween(*before)
    blocks = maps.groupBy("grp", "_block").agg(F.sum("_n").alias("_k"))
    over = Window.partitionBy("grp").orderBy("_block").rowsBetween(*before)
    blocks = blocks.select("grp", "_block", F.coalesce(F.sum("_k").over(over), F.lit(0)).alias("_over"))
    nulls = leaves.filter("doc_id is null").groupBy("grp").agg(F.count(F.lit(1)).alias("_nulls"))
    # only maps with fewer bits than rows are looked at again
    again = ids.join(maps.filter("_more > 0").select("grp", "_map"), ["grp", "_map"], "left_semi")
    again = again.groupBy("grp", "_map", "_pos").agg((F.count(F.lit(1)) - 1).alias("more")).filter("more > 0")
    again = again.groupBy("grp", "_map").agg(F.collect_list(F.struct(F.col("_pos").alias("pos"), "more")).alias("_repeats"))
    return (
        maps.withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(blocks, ["grp", "_block"])
        .join(nulls, "grp", "left")
        .join(again, ["grp", "_map"], "left")
        .withColumn("_before", F.col("_over") + F.col("_inside") + F.coalesce("_nulls", F.lit(0)))
        .drop("_block", "_over", "_inside", "_nulls", "_more")
    )


def leaf_places(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``grp, doc_id, leaf``) with ``idx``: the place in its group by ascending id, from 0 on.

    Null ids come first. Rows of one id stand together in the order of their digests; only such rows are sorted.
    """
    at = F.col("doc_id")
    leaves = leaves.withColumn("_map", F.shiftright(at, MAP_BITS)).withColumn("_pos", at.bitwiseAND(F.lit(SLOTS - 1)))
    maps = durable(bitmaps(leaves))
    rank = F.col("_before") + _bits_before(F.floor(F.col("_pos") / 8).cast("int") - F.col("_first"))
    extra = F.aggregate(
        F.filter("_repeats", lambda r: r["pos"] < F.col("_pos")), F.lit(0).cast("long"), lambda a, r: a + r["more"]
    )
    single = leaves.columns
    found = leaves.filter("doc_id is not null").join(maps, ["grp", "_map"])
    repeated = F.coalesce(F.exists("_repeats", lambda r: r["pos"] == F.col("_pos")), F.lit(False))
    found = found.select(*single, (rank + F.coalesce(extra, F.lit(0))).alias("idx"), repeated.alias("_tied"))
    alone = found.filter("not _tied").drop("_tied")
    nulls = leaves.filter("doc_id is null").withColumn("idx", F.lit(0).cast("long"))
    tied = found.filter("_tied").drop("_tied").unionByName(nulls).withColumn("_row", F.monotonically_increasing_id())
    tied = durable(_sorted_places(tied, ["grp", "idx", "leaf", "_row"]))
    starts = tied.groupBy("grp", "idx").agg(F.min("_place").alias("_start"))
    tied = tied.join(starts, ["grp", "idx"]).withColumn("idx", F.col("idx") + F.col("_place") - F.col("_start"))
    return alone.unionByName(tied.select(alone.columns)).drop("_map", "_pos")


def _levels(nodes: list[str], n: int, slots: int, levels: int) -> list[list[str]]:
    """The levels over one packed array; an array that is its whole tree is reduced until one node remains."""
    rows = [nodes]
    while len(rows[-1]) > 1 if n <= slots else len(rows) <= levels:
        low = rows[-1]
        runs = ["".join(low[k : k + FANOUT]) for k in range(0, len(low), FANOUT)]
        rows.append([hashlib.sha256(run.encode()).hexdigest() for run in runs])
    return rows


def _climb(rows: list[list[str]], slot: int) -> Iterator[tuple[int, list[str]]]:
    """Own place in the run, and the run, of each level below the top."""
    for row in rows[:-1]:
        start = slot - slot % FANOUT
        yield slot - start, row[start : start + FANOUT]
        slot //= FANOUT


def _split(own: int, run: list[str]) -> tuple[str, str]:
    return "".join(run[:own]), "".join(run[own + 1 :])


def _proofs(rows: list[list[str]], above, altered: list[bytes | None]) -> tuple[list[str], list[str]]:
    """Digest of the proof of each leaf of an array, and the root folded from its altered digest.

    The text around a node and all above it is made once for the nodes below it.
    """
    sha = hashlib.sha256
    sides = [_split(own, run) for own, run in above]
    rest = ["".join(a + b for a, b in sides)]
    frames = [sides]
    for row in rows[-2::-1]:
        around = [_split(k % FANOUT, row[k - k % FANOUT : k - k % FANOUT + FANOUT]) for k in range(len(row))]
        rest = [a + b + rest[k // FANOUT] for k, (a, b) in enumerate(around)]
        frames = [[pair, *frames[k // FANOUT]] for k, pair in enumerate(around)]
    folds = []
    for leaf, other, steps in zip(rows[0], altered, frames):
        digest = other.hex() if other else leaf
        for a, b in steps:
            digest = sha((a + digest + b).encode()).hexdigest()
        folds.append(digest)
    return [sha(r.encode()).hexdigest() for r in rest], folds


def _pack_path(steps) -> bytes:
    return b"".join(bytes([len(run), own]) + bytes.fromhex("".join(run)) for own, run in steps)


def _read_path(path: bytes) -> list[tuple[int, list[str]]]:
    steps, at = [], 0
    while at < len(path):
        size, own = path[at], path[at + 1]
        text = path[at + 2 : at + 2 + 32 * size].hex()
        steps.append((own, [text[k : k + 64] for k in range(0, len(text), 64)]))
        at += 2 + 32 * size
    return steps


def _slots(nodes: DataFrame, *payload: str) -> DataFrame:
    """Nodes (``grp, idx, n, digest``) in packed arrays: ``grp, idx`` (of the array), ``n``, ``slots``."""
    entry = F.struct(F.col("idx").bitwiseAND(F.lit(SLOTS - 1)).cast("int").alias("slot"), "digest", *payload)
    packed = nodes.groupBy("grp", F.shiftright("idx", SLOT_BITS).alias("idx"), "n")
    return packed.agg(F.array_sort(F.collect_list(entry)).alias("slots"))


def _tops(packed: DataFrame) -> DataFrame:
    """The node over each packed array, in the numbering of the next round."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tops = [
                bytes.fromhex(_levels([bytes(d).hex() for d in digests], n, SLOTS, LEVELS)[-1][0])
                for digests, n in zip(batch["digests"], batch["n"])
            ]
            above = -(-batch["n"] // SLOTS)
            yield pd.DataFrame({"grp": batch["grp"], "idx": batch["idx"], "n": above, "digest": tops})

    digests = F.transform("slots", lambda s: s["digest"]).alias("digests")
    return packed.select("grp", "idx", "n", digests).mapInPandas(run, NODES)


def _children(packed: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths (``grp, idx, path``) of the nodes in packed arrays, from the paths of the arrays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                rows = _levels([bytes(d).hex() for d in row.digests], row.n, SLOTS, LEVELS)
                head, above = bytes(row.path[:64]), bytes(row.path[64:])
                paths = [head + _pack_path(_climb(rows, k)) + above for k in range(len(rows[0]))]
                idx = [row.idx * SLOTS + k for k in range(len(paths))]
                yield pd.DataFrame({"grp": row.grp, "idx": idx, "path": paths})

    digests = F.transform("slots", lambda s: s["digest"]).alias("digests")
    met = packed.select("grp", "idx", "n", digests).join(paths, ["grp", "idx"])
    return met.mapInPandas(run, "grp string, idx long, path binary")


def _rounds(first: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Packed arrays of every round from the first one's up, and the root of each group (``grp, digest``)."""
    rounds, roots = [first], []
    while True:
        tops = durable(_tops(rounds[-1]))
        # a tree that fits in one array ends there
        roots.append(tops.filter("n = 1").select("grp", "digest"))
        if tops.filter("n > 1").isEmpty():
            return rounds, reduce(DataFrame.unionByName, roots)
        rounds.append(durable(_slots(tops.filter("n > 1"))))


def _paths(rounds: list[DataFrame], heads: DataFrame) -> DataFrame:
    """Paths of the arrays of the first round; ``heads`` (``grp, path``) are those of the groups' roots."""
    paths = None
    for k in range(len(rounds) - 1, -1, -1):
        tops = rounds[k].filter(F.col("n") <= SLOTS).select("grp", "idx").join(heads, "grp")
        if paths is not None:
            tops = tops.unionByName(_children(rounds[k + 1], paths))
        paths = durable(tops)
    return paths


def manifest(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Trees over ``leaves`` (``grp, doc_id, leaf, altered``: digests in hexadecimal).

    Returns the packed arrays of each round, the root of each group in order (``grp, idx, digest``), and the
    arrays' paths: root and group root, then the runs from the array up to the root.
    """
    sizes = leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    placed = leaf_places(leaves).join(sizes, "grp")
    nodes = placed.select(
        "grp", "idx", "n", F.unhex("leaf").alias("digest"), "doc_id", F.unhex("altered").alias("altered")
    )
    rounds, roots = _rounds(durable(_slots(nodes, "doc_id", "altered")))
    roots = durable(_sorted_places(roots, ["grp"])).withColumnRenamed("_place", "idx")
    # the trees' roots are the leaves of one more tree
    whole = roots.select(F.lit("").alias("grp"), "idx", F.lit(roots.count()).cast("long").alias("n"), "digest")
    top_rounds, root = _rounds(durable(_slots(whole)))
    top = _paths(top_rounds, root.select("grp", F.concat("digest", "digest").alias("path")))
    ends = _children(top_rounds[0], top).select("idx", "path")
    heads = roots.join(ends, "idx").select(
        "grp", F.concat(F.substring("path", F.lit(1), F.lit(32)), "digest", F.expr("substring(path, 65)")).alias("path")
    )
    return rounds, roots, _paths(rounds, durable(heads))


def prove(leaves: DataFrame) -> DataFrame:
    """One row per leaf with its group root, root, digest of its proof and the root folded from its altered digest.

    ``leaves`` holds ``grp`` (text; groups are ordered by its bytes), ``doc_id`` (long), ``leaf`` and
    ``altered`` (hexadecimal sha256; null: not altered). The proof is the other digests of each run from the
    leaf to the root; folding puts the altered digest in their place and hashes upwards, and a row is
    verified when that ends in the root. Null ids come first; equal ids are ordered by digest and equal rows
    each keep a place; an empty table gives no rows.
    """
    rounds, _, paths = manifest(leaves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaf = [d.hex() for d in row["digests"]]
                rows = _levels(leaf, row["n"], SLOTS, LEVELS)
                path = row["path"]
                root, subroot, above = path[:32].hex(), path[32:64].hex(), _read_path(path[64:])
                proofs, folds = _proofs(rows, above, row["altered"])
                size = len(leaf)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()),
                        pa.array([row["grp"]] * size, pa.string()),
                        pa.array(leaf, pa.string()),
                        pa.array([subroot] * size, pa.string()),
                        pa.array([root] * size, pa.string()),
                        pa.array(proofs, pa.string()),
                        pa.array(folds, pa.string()),
                        pa.array([f == root for f in folds], pa.bool_()),
                    ],
                    names=["doc_id", "grp", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    arrays = [
        F.transform("slots", lambda s: s["digest"]).alias("digests"),
        F.transform("slots", lambda s: s["doc_id"]).alias("ids"),
        F.transform("slots", lambda s: s["altered"]).alias("altered"),
    ]
    return rounds[0].join(paths, ["grp", "idx"]).select("grp", "n", "path", *arrays).mapInArrow(run, PROVEN)


def group_key(col: str) -> Column:
    """Text that orders null first and all else by its bytes."""
    return F.when(F.col(col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(col).cast("string")))


def verify_documents(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """Manifest of documents by language: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Leaves hash ``doc_id, source, lang, n_chars, text`` of the stored rows. ``altered`` is the text to check
    against them, null where nothing changed (default: nowhere). Null text, language or id are values of their own; texts
    of any length are hashed whole; extra columns, ``grp`` or ``leaf`` among them, are ignored.
    """
    fields = ["doc_id", "source", "lang", "n_chars"]
    other = F.lit(None).cast("string") if altered is None else altered
    leaves = docs.select(
        group_key("lang").alias("grp"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest([*fields, "text"]).alias("leaf"),
        F.when(other.isNotNull(), leaf_digest([*fields, other])).alias("altered"),
    )
    return prove(durable(leaves)).drop("grp")
