"""Near-duplicate embeddings by dual traversal of cover trees.

Vectors of one label are compared on the unit sphere, where a cosine bound is a distance bound. Exact copies
are one vector with a count. A bounded sample of pivots cuts each label into cells, and cells into blocks of
bounded size; cell pairs whose covering balls are farther apart than the bound are never joined. A task that
gets two blocks builds a cover tree of each - nested levels whose radii halve, every node with its covering
radius - and walks both at once from the roots: a pair of nodes goes on only if its centres are within the sum
of their radii and the bound. Leaves are compared vector by vector in double precision. All pairs within the bound
are found; only link counts and a spanning set of links leave the task.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.links import components
from tidemark.session import durable

COSINE = 0.98
#: Pivots of a label, vectors of a block, and vectors of a tree's leaf.
PIVOTS = 8
BLOCK = 1_500
LEAF = 32
#: Room for rounding in bounds; decisions are made on cosines.
SLACK = 1e-6


@dataclasses.dataclass
class Node:
    center: int
    radius: float
    members: np.ndarray
    children: list[Node]


def build(unit: np.ndarray, members: np.ndarray | None = None, reach: float = 2.0) -> Node:
    """Cover tree over rows of ``unit``; each level's centres cover their node within half the radius above."""
    members = np.arange(len(unit)) if members is None else members
    center = int(members[0])
    radius = float(_distance(unit[members], unit[center]).max(initial=0.0))
    node = Node(center, radius, members, [])
    if len(members) <= LEAF or radius < SLACK:
        return node
    reach = min(reach, 2.0 ** np.ceil(np.log2(radius))) / 2
    while not node.children:
        rest, groups = members, []
        while len(rest):
            near = _distance(unit[rest], unit[rest[0]]) <= reach
            groups.append(rest[near])
            rest = rest[~near]
        if len(groups) > 1:
            node.children = [build(unit, g, reach) for g in groups]
        reach /= 2
    return node


def _distance(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((rows - point) ** 2).sum(axis=-1), 0.0))


def traverse(left: Node, right: Node, x: np.ndarray, y: np.ndarray, bound: float):
    """Pairs of member lists that may hold vectors within ``bound``; each unordered pair once for one tree."""
    stack = [(left, right)]
    while stack:
        a, b = stack.pop()
        if not a.children and not b.children:
            yield a.members, b.members
            continue
        same = a is b
        ups = a.children or [a]
        downs = b.children or [b]
        cx, cy = x[[n.center for n in ups]], y[[n.center for n in downs]]
        apart = np.sqrt(np.maximum((cx**2).sum(1)[:, None] + (cy**2).sum(1) - 2 * cx @ cy.T, 0.0))
        reach = np.array([n.radius for n in ups])[:, None] + np.array([n.radius for n in downs]) + bound + SLACK
        near = apart <= reach
        if same:
            near = np.triu(near)
        stack += [(ups[i], downs[j]) for i, j in zip(*np.nonzero(near))]


def match(x, y, ids_x, ids_y, many_x, many_y, least: float, same: bool):
    """Link counts of the rows of two blocks of unit vectors and spanning links between them."""
    bound = float(np.sqrt(max(0.0, 2 - 2 * least)))
    ux, uy = (v / np.sqrt((v * v).sum(1))[:, None] for v in (x, y))
    left = build(ux)
    right = left if same else build(uy)
    count_x, count_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    norm_x, norm_y = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    up: dict[int, int] = {}

    def root(v):
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    links = []
    for p, q in traverse(left, right, ux, uy, bound):
        near = (x[p] @ y[q].T) / (norm_x[p][:, None] * norm_y[q]) >= least
        one = same and p is q
        if one:
            np.fill_diagonal(near, False)
        if not near.any():
            continue
        count_x[p] += near @ many_y[q]
        if not one:
            count_y[q] += many_x[p] @ near
        # a vector joins what its first partner is in, then every further partner is checked
        for i in np.flatnonzero(near.any(1)):
            for j in np.flatnonzero(near[i]):
                a, b = int(ids_x[p[i]]), int(ids_y[q[j]])
                ra, rb = root(a), root(b)
                if ra != rb:
                    up[max(ra, rb)] = min(ra, rb)
                    links.append((a, b))
    if same:
        count_x, count_y = count_x + count_y, count_y[:0]
    return count_x, count_y, links


def _unit(e: Column) -> Column:
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(e, lambda v: v / norm)


def _pivots(copies: DataFrame) -> DataFrame:
    """``label, cell, center``: at most ``PIVOTS`` vectors a label, those with the smallest hash in as many parts."""
    part = F.pmod(F.xxhash64("first"), F.lit(PIVOTS)).cast("int").alias("cell")
    picked = copies.groupBy("label", part).agg(F.min_by("e", "first").alias("e"))
    return durable(picked.select("label", "cell", _unit(F.col("e")).alias("center")))


def _homes(copies: DataFrame, pivots: DataFrame) -> DataFrame:
    """Every vector with its nearest pivot's cell and its distance from it."""
    table = pivots.groupBy("label").agg(F.collect_list(F.struct("cell", "center")).alias("pivots"))

    def nearest(batches):
        for batch in batches:
            cell, away = [], []
            for e, pivots in zip(batch["e"], batch["pivots"]):
                e = np.asarray(e, np.float64)
                far = _distance(np.array([list(p["center"]) for p in pivots]), e / np.sqrt((e * e).sum()))
                k = int(far.argmin())
                cell.append(pivots[k]["cell"])
                away.append(float(far[k]))
            yield batch[["label", "first", "many", "e"]].assign(cell=cell, away=away)

    schema = "label string, first long, many long, e array<double>, cell int, away double"
    return copies.join(table, "label").mapInPandas(nearest, schema)


def near_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row (columns ``vec_id``, ``embedding``, ``label``).

    Vectors of one label link when their cosine is at least ``least`` (above 0). Null labels and vectors that
    are null, empty, zero or hold null or non-finite components link with nothing; vectors of different
    lengths do not link. A null vec_id links with nothing and has null component and kept. Repeated rows of a
    vec_id link like any two vectors, and share its component. Extra columns are ignored.
    """
    e = F.transform("embedding", lambda v: v.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long"), e.alias("e"), F.col("label").cast("string"))
    sound = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.coalesce(F.size("e") > 0, F.lit(False))
        & F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("e", lambda v: v != 0)
    )
    # scaled by its largest component, so no square under- or overflows
    good = rows.filter(sound).withColumn("top", F.array_max(F.transform("e", lambda v: F.abs(v))))
    good = good.withColumn("e", F.transform("e", lambda v: v / F.col("top") + 0.0))
    good = durable(good.select("vec_id", F.concat_ws("/", "label", F.size("e")).alias("label"), "e"))
    copies = good.groupBy("label", "e").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("many"))
    copies = durable(copies)
    pivots = _pivots(copies)
    homed = durable(_homes(copies, pivots))
    cells = homed.groupBy("label", "cell").agg(
        F.max("away").alias("radius"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")
    )
    cells = cells.join(pivots, ["label", "cell"])
    other = cells.select("label", *[F.col(c).alias(f"{c}2") for c in ("cell", "radius", "blocks", "center")])
    gap = F.sqrt(F.aggregate(F.zip_with("center", "center2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    bound = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    joined = cells.join(other, "label").filter("cell <= cell2").filter(gap <= F.col("radius") + F.col("radius2") + bound)
    # every block of one cell meets every block of the other, once
    units = (
        joined.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("blocks2") - 1)))
        .filter("cell < cell2 or b <= b2")
        .select("label", "cell", "cell2", "b", "b2")
    )
    sizes = cells.select("label", "cell", "blocks")
    placed = homed.join(sizes, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("first", F.lit(7)), F.col("blocks")).cast("int"))
    placed = placed.select("label", "cell", "block", "first", "many", "e")
    unit = F.struct("cell", "b", "cell2", "b2").alias("unit")
    sides = units.select("label", unit, F.col("cell").alias("c"), F.col("b").alias("block"), F.lit(0).alias("side")).union(
        units.filter("cell <> cell2 or b <> b2").select("label", unit, "cell2", "b2", F.lit(1))
    )
    dealt = sides.withColumnRenamed("c", "cell").join(placed, ["label", "cell", "block"])
    dealt = dealt.select("label", "unit.*", "side", "first", "many", "e")

    def compare(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        ids, many = table["first"].to_numpy(), table["many"].to_numpy()
        e = np.stack([np.asarray(v, np.float64) for v in table["e"].to_numpy()])
        order = np.argsort(ids, kind="stable")
        a, b = order[side[order] == 0], order[side[order] == 1]
        # an empty side has nothing to meet; one side only is a block with itself
        same = table["cell"][0].as_py() == table["cell2"][0].as_py() and table["b"][0].as_py() == table["b2"][0].as_py()
        if not len(a) or (not same and not len(b)):
            return pa.table({c: pa.array([], pa.int64()) for c in ("vec", "links", "other")})
        if same:
            b = a
        cx, cy, links = match(e[a], e[b], ids[a], ids[b], many[a], many[b], least, same)
        vec = np.concatenate([ids[a], ids[b][: len(cy)]])
        n = np.concatenate([cx, cy])
        kept = n > 0
        count = int(kept.sum())
        return pa.table(
            {
                "vec": pa.array(vec[kept].tolist() + [x for x, _ in links], pa.int64()),
                "links": pa.array(n[kept].tolist() + [None] * len(links), pa.int64()),
                "other": pa.array([None] * count + [y for _, y in links], pa.int64()),
            }
        )

    found = durable(
        dealt.groupBy("label", "cell", "b", "cell2", "b2").applyInArrow(compare, "vec long, links long, other long")
    )
    counts = found.filter("links is not null").groupBy("vec").agg(F.sum("links").alias("links"))
    firsts = good.join(copies, ["label", "e"]).select("vec_id", "first", "many", "label")
    pairs = found.filter("other is not null").select(F.col("vec").alias("a"), F.col("other").alias("b"))
    linked = components(pairs.union(firsts.select(F.col("vec_id").alias("a"), F.col("first").alias("b"))))
    per_row = firsts.join(counts, F.col("first") == F.col("vec"), "left").select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n")
    )
    per_row = per_row.groupBy("vec_id").agg(F.max("n").alias("n"))
    return (
        rows.select("vec_id")
        .join(per_row, "vec_id", "left")
        .join(linked, F.col("vec_id") == F.col("node"), "left")
        .select(
            "vec_id",
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
            (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"),
        )
    )
