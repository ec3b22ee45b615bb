"""Near-duplicate documents by the Jaccard similarity of their word shingles.

Signatures: a document with n shingles may lack at most e = floor(0.2 n) of them in a similar one, so one of any
e + 1 of its shingles is shared. Shingles are in two classes, rare and frequent, and taken rare ones first, in
hash order. If e + 1 rare ones exist, these are the signatures. Otherwise the prefix is extended by frequent
ones, which are indexed only as pairs: they are dealt into sets by hash, and a set with k of them adds all
pairs and counts as k - 1 (what is left after k - 1 losses still holds no pair), until e + 1 is reached. How many
sets there are follows from the document's size class, and documents sign for their class and the next, so
two similar ones always share a signature.

Classes come from counts over all documents. Signatures travel packed, one row per task block and hash bucket.
A signature of few documents gives candidate pairs. Each is first judged by profiles, the numbers of a set's
shingles in ranges of the hash: two sets share at most the sum of the smaller numbers, so a pair below the
bound goes without a look at the sets. Documents of a signature with many are only chained to its first one.
The families that pairs and chains form are dealt into blocks of bounded size and verified block against
block on whole sets, so a set travels once per block pair and not once per candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.links import components
from tidemark.session import discard, durable

WORDS = 5
#: Similarity in percent.
PERCENT = 80
#: Documents up to which a shingle is rare, and bits of the table of frequent ones (a wrong bit costs time only).
RARE = 16
TABLE_BITS = 24
#: Shingles of a block, hash buckets for each shuffle partition, documents of a block of a family.
BLOCK_SHINGLES = 2_000_000
BUCKETS = 32
FAMILY_BLOCK = 256
#: Bits of a hash that tell the finest ranges of a profile apart.
PROFILE_BITS = 12

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    """Hash of each word, kept until there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * ODD[3]
    h = (h ^ (h >> np.uint64(29))) * ODD[4]
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: dict) -> np.ndarray:
    """Sorted distinct hashes of the five-word shingles; of all words together if there are fewer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    total = np.full(n, np.uint64(min(len(h), WORDS)))
    for k in range(min(WORDS, len(h))):
        total += h[k : k + n] * ODD[k]
    return np.unique(_mix(total))


def spare(n: int) -> int:
    """Shingles of ``n`` that a similar document may lack."""
    return n - -(-PERCENT * n // 100)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both) and both > 0


def profile(tokens: np.ndarray) -> bytes:
    """Numbers of shingles in equal ranges of the hash, as many ranges as shingles (a power of two); the last
    number of a byte means that many or more."""
    bits = max(3, min(PROFILE_BITS, len(tokens).bit_length()))
    counts = np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def may_be_similar(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether sets of n and m shingles with these profiles can share enough of them."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if a.max() == 255 or b.max() == 255:
        return True
    size = min(len(a), len(b))
    shared = np.minimum(a.reshape(size, -1).sum(axis=1), b.reshape(size, -1).sum(axis=1)).sum()
    return 100 * shared >= PERCENT * (n + m - shared)


def size_class(n: int) -> int:
    """Similar sizes are in the same class or in neighbouring ones."""
    return int(np.floor(np.log(n) / np.log(1.25) + 1e-9))


def signatures(tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Signatures of one document from its sorted shingle hashes and which of them are frequent."""
    need = spare(len(tokens)) + 1
    rare = tokens[~frequent]
    if len(rare) >= need:
        return rare[:need]
    out = [rare]
    often = tokens[frequent]
    own = size_class(len(tokens))
    for level in (own, own + 1):
        sets = max(1, int(1.25**level) // 6)
        group = ((often >> np.uint64(20)) % np.uint64(sets)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        edges = np.flatnonzero(np.diff(group[order], prepend=-1, append=sets))
        credit = len(rare)
        for a, b in zip(edges[:-1], edges[1:]):
            if credit >= need:
                break
            if b - a > 1:
                credit += b - a - 1
                i, j = np.triu_indices(b - a, 1)
                t = often[order[a:b]]
                out.append(_mix(t[i] * ODD[0] + t[j] * ODD[1] + ODD[2:3] * np.uint64(level + 1)))
    return np.concatenate(out)


def _documents(batches: Iterator[pa.RecordBatch]):
    """Blocks of (ids, sets) with about ``BLOCK_SHINGLES`` shingles; rows without id have None."""
    words = _Words()
    ids, sets, size = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc)
            sets.append(shingles(text, words))
            size += len(sets[-1])
            if size >= BLOCK_SHINGLES:
                yield ids, sets
                ids, sets, size = [], [], 0
    if ids:
        yield ids, sets


def _first_of_copies(ids, sets) -> tuple[list[int], list[bytes | None]]:
    """For each document of a block the place of the first one with the same set, and the digest of its set."""
    seen: dict[bytes, int] = {}
    digests = [None if d is None or not len(s) else xxhash.xxh3_128_digest(s.tobytes()) for d, s in zip(ids, sets)]
    return [k if d is None else seen.setdefault(d, k) for k, d in enumerate(digests)], digests


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _split(bucket: np.ndarray, *columns: np.ndarray):
    """Bucket numbers present and, for each, its part of every column."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    ends = np.append(first[1:], len(bucket))
    return found, [[c[a:b].tobytes() for a, b in zip(first, ends)] for c in (x[order] for x in columns)]


def frequent_table(texts: DataFrame, buckets: int) -> np.ndarray:
    """Bit table of shingles in more than ``RARE`` documents (exact copies within a block count once).

    Its size is fixed, whatever the number of documents; it is read by the low bits of a hash.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _documents(batches):
            firsts, _ = _first_of_copies(ids, sets)
            some = [s for k, s in enumerate(sets) if firsts[k] == k and ids[k] is not None and len(s)]
            if not some:
                continue
            h, n = np.unique(np.concatenate(some), return_counts=True)
            h = np.repeat(h, np.minimum(n, RARE + 1))
            found, (low,) = _split(_bucket(h, buckets), h.astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(low, pa.binary())], names=["bucket", "low"])

    def tally(table: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint32)
        h, n = np.unique(low, return_counts=True)
        bits = np.unique(h[n > RARE] & np.uint32((1 << TABLE_BITS) - 1))
        return pa.table({"bit": pa.array(bits, pa.int64())})

    packed = texts.mapInArrow(count, "bucket long, low binary")
    bits = packed.groupBy("bucket").applyInArrow(tally, "bit long")
    pages = bits.groupBy(F.bitmap_bucket_number("bit").alias("page")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")
    )
    table = np.zeros(1 << TABLE_BITS, bool)
    for r in durable(pages).toLocalIterator():
        # Spark counts positions from 1 within pages of 32,768, but 0 is in the first page
        part = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little").astype(bool)
        at = np.flatnonzero(part) + (r.page - 1) * 32_768 + 1 if r.page else np.array([0])
        table[at[at < len(table)]] = True
    return table


PACKED = (
    "bucket long, sig binary, doc binary, size binary, "
    "doc_id long, first long, n long, digest binary, profile binary"
)


def _packed(texts: DataFrame, table: np.ndarray, buckets: int) -> DataFrame:
    """Two kinds of rows: packed signatures, and one row per document."""
    shared = texts.sparkSession.sparkContext.broadcast(np.packbits(table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(shared.value).astype(bool)
        names = [c.split()[0] for c in PACKED.split(", ")]
        kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 3, *[pa.binary()] * 2]

        def batch_of(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            made = [pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, kinds)]
            return pa.RecordBatch.from_arrays(made, names=names)

        for ids, sets in _documents(batches):
            firsts, digests = _first_of_copies(ids, sets)
            sigs, docs, sizes = [], [], []
            for k, s in enumerate(sets):
                if firsts[k] != k or ids[k] is None or not len(s):
                    continue
                frequent = bits[s & np.uint64(len(bits) - 1)]
                sig = signatures(s, frequent)
                sigs.append(sig)
                docs.append(np.full(len(sig), ids[k], np.int64))
                sizes.append(np.full(len(sig), len(s), np.int32))
            own = {"doc_id": ids, "first": [ids[f] for f in firsts], "n": [len(s) for s in sets], "digest": digests}
            own["profile"] = [profile(s) if firsts[k] == k and len(s) else None for k, s in enumerate(sets)]
            yield batch_of(**own)
            if sigs:
                h = np.concatenate(sigs)
                found, cols = _split(_bucket(h, buckets), h.astype(np.uint32), np.concatenate(docs), np.concatenate(sizes))
                yield batch_of(bucket=found, sig=cols[0], doc=cols[1], size=cols[2])

    return texts.mapInArrow(run, PACKED)


def _candidates(packed: DataFrame) -> DataFrame:
    """``a, b, chained``: pairs that share a signature, or links of a document to a signature's first one."""

    def match(table: pa.Table) -> pa.Table:
        sig, doc, size = (
            np.frombuffer(b"".join(table[c].to_pylist()), t)
            for c, t in (("sig", np.uint32), ("doc", np.int64), ("size", np.int32))
        )
        order = np.lexsort((doc, sig))
        sig, doc, size = sig[order], doc[order], size[order]
        first = np.flatnonzero(np.diff(sig.astype(np.int64), prepend=-1))
        length = np.diff(np.append(first, len(sig)))
        left, right, kind = [], [], []
        many = length > RARE
        if many.any():
            at = np.repeat(first[many], length[many])
            inside = np.arange(len(at)) - np.repeat(np.cumsum(length[many]) - length[many], length[many])
            left.append(at[inside > 0])
            right.append((at + inside)[inside > 0])
            kind.append(np.ones(len(left[-1]), bool))
        few = first[(length > 1) & ~many], length[(length > 1) & ~many]
        for gap in range(1, RARE):
            for start in range(RARE - gap):
                at = few[0][few[1] > start + gap] + start
                left.append(at)
                right.append(at + gap)
                kind.append(np.zeros(len(at), bool))
        x, y, kind = np.concatenate(left), np.concatenate(right), np.concatenate(kind)
        near = kind | (100 * np.minimum(size[x], size[y]).astype(np.int64) >= PERCENT * np.maximum(size[x], size[y]))
        near &= doc[x] != doc[y]
        pairs = np.unique(np.stack([doc[x], doc[y], kind.astype(np.int64)], 1)[near], axis=0)
        low, high = np.minimum(pairs[:, 0], pairs[:, 1]), np.maximum(pairs[:, 0], pairs[:, 1])
        return pa.table({"a": low, "b": high, "chained": pairs[:, 2] == 1})

    rows = packed.filter("bucket is not null").select("bucket", "sig", "doc", "size")
    found = rows.groupBy("bucket").applyInArrow(match, "a long, b long, chained boolean")
    return found.distinct()


def _copies(own: DataFrame) -> DataFrame:
    """``doc_id, same`` (smallest id with an equal set) of the first of each set in a block."""
    firsts = own.filter("first = doc_id and digest is not null").select("doc_id", "digest").distinct()
    least = firsts.groupBy("digest").agg(F.min("doc_id").alias("same"))
    return durable(firsts.join(least, "digest").select("doc_id", "same"))


def _of_representatives(found: DataFrame, copies: DataFrame) -> DataFrame:
    """Candidates between sets instead of documents: each equal set is verified once."""
    a, b = (copies.select(F.col("doc_id").alias(c), F.col("same").alias(f"{c}_")) for c in "ab")
    ends = F.least("a_", "b_").alias("a"), F.greatest("a_", "b_").alias("b")
    return found.join(a, "a").join(b, "b").filter("a_ <> b_").select(*ends, "chained").distinct()


def _with_sets(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``doc_id, shingles`` of the documents in ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sets = [shingles(t, words).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return texts.join(nodes, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def _judged(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose profiles leave room for enough shared shingles; none that links is lost."""
    # an id with several texts stands with each of them
    known = own.filter("profile is not null").select("doc_id", "profile", "n").distinct()
    left = known.select(F.col("doc_id").alias("a"), F.col("profile").alias("x"), F.col("n").alias("nx"))
    right = known.select(F.col("doc_id").alias("b"), F.col("profile").alias("y"), F.col("n").alias("ny"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(2, 6)))
            near = [may_be_similar(x, y, n, m) for x, y, n, m in rows]
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "nx", "ny")
    return joined.mapInArrow(run, "a long, b long")


def _family_links(family: DataFrame, sets: DataFrame, deals: int) -> DataFrame:
    """Links within families (``doc_id, component``): every pair of a family is compared, in blocks, and a
    spanning set is returned."""
    sizes = family.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / FAMILY_BLOCK).cast("int").alias("blocks"))
    placed = (
        family.join(sizes, "component")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .join(sets, "doc_id")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("component", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "blocks", "doc_id", "shingles")
    )
    # families of one block share groups, so that many small ones cost few of them
    small = F.pmod(F.xxhash64("component"), F.lit(deals))
    placed = placed.withColumn("deal", F.when(F.col("blocks") == 1, small).otherwise(F.xxhash64("component", "p", "q")))

    def compare(table: pa.Table) -> pa.Table:
        ids, component, p, q = (np.array(table[c].to_pylist(), np.int64) for c in ("doc_id", "component", "p", "q"))
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        order = np.lexsort((q, p, component))
        key = np.stack([component, p, q])[:, order]
        starts = np.flatnonzero(np.append(True, (np.diff(key) != 0).any(axis=0)))
        left, right = [], []
        for rows in np.split(order, starts[1:]):
            x, y = _spanning(ids[rows], [sets[k] for k in rows])
            left += x
            right += y
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return placed.groupBy("deal").applyInArrow(compare, "a long, b long")


def _spanning(ids: np.ndarray, sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """One link for each document that joins a cluster of similar ones."""
    tokens, place = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), size)
    both = np.zeros((len(sets), len(sets)), np.int64)
    # incidence matrix in strips, so it stays small for long documents
    strip = max(256, 20_000_000 // len(sets))
    for k in range(0, len(tokens), strip):
        inside = (place >= k) & (place < k + strip)
        part = np.zeros((len(sets), min(strip, len(tokens) - k)), np.float32)
        part[row[inside], place[inside] - k] = 1
        both += (part @ part.T).astype(np.int64)
    near = 100 * both >= PERCENT * (size[:, None] + size[None, :] - both)
    left, right = [], []
    open_ = np.ones(len(sets), bool)
    for start in range(len(sets)):
        if open_[start]:
            open_[start] = False
            queue = [start]
            while queue:
                u = queue.pop()
                fresh = np.flatnonzero(near[u] & open_)
                open_[fresh] = False
                left += [int(ids[u])] * len(fresh)
                right += ids[fresh].tolist()
                queue += fresh.tolist()
    return left, right


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs`` (columns ``doc_id``, ``text``).

    Documents link when the Jaccard similarity of their sets is at least 0.8; the component is the smallest
    doc_id reachable. A-Z is lower-cased and words end at ASCII white space. Null and empty texts have an
    empty set and link with nothing; rows with a null doc_id link with nothing and get a null component;
    rows of one doc_id are one node. Extra columns are ignored; texts of any length are read whole.
    """
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    packed = durable(_packed(texts, frequent_table(texts, buckets), buckets))
    own = durable(packed.filter("n is not null").select("doc_id", "first", "n", "digest", "profile"))
    copies = _copies(own)
    found = durable(_of_representatives(_candidates(packed), copies))
    discard(packed)
    pairs = durable(_judged(found.filter("not chained").select("a", "b"), own))
    # pairs and chains form families apart, so that a frequent signature does not tie small families together
    near = components(pairs).select(F.col("node").alias("doc_id"), "component")
    often = components(found.filter("chained").select("a", "b")).select(F.col("node").alias("doc_id"), "component")
    near, often = durable(near), durable(often)
    nodes = near.select("doc_id").union(often.select("doc_id")).distinct()
    sets = durable(_with_sets(texts, durable(nodes)))
    links = durable(_family_links(near, sets, buckets // 4).union(_family_links(often, sets, buckets // 4)))
    discard(sets, pairs, found)
    own = own.drop("profile")
    twins = own.filter("first <> doc_id").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    twins = twins.union(copies.filter("doc_id <> same").select("doc_id", "same"))
    every = links.union(twins)
    linked = components(every)
    return own.join(linked, own.doc_id == linked.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")
    )
