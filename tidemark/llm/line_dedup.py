"""Removal of lines that an earlier document already holds, with DataFrame functions only.

Line hashes are range-partitioned and sorted within a partition by document and position, and each sorted
range is streamed once for the first document of every hash. A hash that fills a third of all rows would be
one range, so the range key holds a salt of the document as well: a row behind an earlier document of its
own salt is settled there, and only the first document of each (hash, salt) goes on to a second, equal pass
without the salt, at most one document a salt. Only hashes and positions are shuffled, never lines.

The result is a run-length encoded keep bitmap per document: lengths of runs of lines that stay and lines
that go, in turn, beginning with lines that stay; what lies behind the last run stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import durable

#: Code points below which a line is never dropped.
MIN_CHARS = 10
#: Fixed value: the white space that does not count, and letters without case.
BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _version(docs: DataFrame) -> Column:
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _late(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows in sorted ranges of ``keys`` with ``late``: an earlier document holds the key.

    The ranges are those of the window, so it adds no shuffle.
    """
    ordered = Window.partitionBy(*keys).orderBy("doc_id", "pos")
    return rows.repartitionByRange(*keys).withColumn("late", F.col("doc_id") != F.first("doc_id").over(ordered))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, version, runs, n_dropped`` of the documents that lose lines.

    A line's key is the line without outer white space, A-Z in lower case. Keys of at least ``min_chars``
    code points in two or more documents lose all their lines but those of the smallest doc_id. Null text
    is one empty line; rows with a null doc_id are left whole and hold nothing against others; repeated rows
    of one doc_id count as one document.
    """
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long"),
        _version(docs).alias("version"),
        F.posexplode(F.transform(lines(F.col("text")), line_key)).alias("pos", "key"),
    )
    hashed = placed.filter(F.length("key") >= min_chars).select(
        # two hashes with different seeds: 128 bits
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit(1), "key").alias("h2"),
        F.pmod(F.hash("doc_id"), F.lit(salts)).alias("salt"),
        "doc_id",
        "version",
        "pos",
    )
    first = durable(_late(hashed, ["h1", "h2", "salt"]))
    second = _late(first.filter(~F.col("late")).drop("late", "salt"), ["h1", "h2"])
    place = ["doc_id", "version", "pos"]
    dropped = first.filter("late").select(place).union(second.filter("late").select(place)).distinct()
    sorted_pos = dropped.groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    p = F.col("p")
    spans = sorted_pos.select(
        "doc_id",
        "version",
        F.size(p).cast("long").alias("n_dropped"),
        F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1)).alias("a"),
        F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1)).alias("b"),
    )
    b = F.col("b")
    pairs = F.transform(
        F.col("a"),
        lambda x, i: F.array(x - F.when(i == 0, F.lit(0)).otherwise(F.get(b, i - 1) + 1), F.get(b, i) - x + 1),
    )
    return spans.select("doc_id", "version", F.flatten(pairs).alias("runs"), "n_dropped")


def kept_lines(text: Column, runs: Column) -> Column:
    """Lines of ``text`` that the keep bitmap ``runs`` leaves (null: all)."""
    flags = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    stays = F.filter(F.arrays_zip(lines(text).alias("line"), flags.alias("keep")), lambda x: F.coalesce(x["keep"], F.lit(True)))
    return F.when(runs.isNull(), lines(text)).otherwise(F.transform(stays, lambda x: x["line"]))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with ``kept`` (the lines that stay, joined), ``runs``, ``n_lines`` and ``n_dropped``.

    Every row and column of ``docs`` is kept, in any number of copies; columns of these four names are
    replaced. An empty table stays empty.
    """
    bits = keep_bitmaps(docs, min_chars).select(
        F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), "runs", "n_dropped"
    )
    plain = docs.drop("kept", "runs", "n_lines", "n_dropped")
    on = (F.col("doc_id").cast("long") == F.col("_doc")) & (_version(plain) == F.col("_version"))
    return (
        plain.join(bits, on, "left")
        .withColumn("n_lines", F.size(lines(F.col("text"))).cast("long"))
        .withColumn("n_dropped", F.coalesce("n_dropped", F.lit(0).cast("long")))
        .withColumn("kept", F.array_join(kept_lines(F.col("text"), F.col("runs")), "\n"))
        .drop("_doc", "_version")
    )
