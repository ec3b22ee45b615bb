"""Connected components of a link table, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import discard, durable


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (smallest reachable id) of all nodes in ``links`` (columns ``a``, ``b``).

    Each round hangs the larger neighbours of every node on its smallest one, then every node's smaller
    neighbours on the smallest of them, until nothing changes. Minima are aggregated before they move and
    the joins are plain ones, so a node with very many links is split. Each round is written as a table.
    Links with a null end and links of a node with itself are left out.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    tree = links.filter("a is not null and b is not null and a <> b").select(a.alias("a"), b.alias("b")).distinct()
    tree = durable(tree)
    state = None
    while True:
        both = tree.union(tree.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # the smallest neighbour itself keeps its place through its larger ones
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        last, tree = tree, durable(small.filter("a <> b").distinct())
        discard(last)
        now = tree.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    roots = tree.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return tree.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct()
