"""The fee histogram: widening half-open bins from 1 to 1000 and an open last one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HISTOGRAM_PREFIX = "mempool_fee_histogram_bin_"

# Fixed values: (from, to, width) of each run of equally wide bins; 1000 and more go to the last.
BIN_RUNS = [(1, 10, 1), (10, 30, 2), (30, 100, 5), (100, 1000, 50)]
OPEN_BIN = "1000_plus"


def bin_labels() -> list[str]:
    labels = [f"{lo}_{lo + w}" for a, b, w in BIN_RUNS for lo in range(a, b, w)]
    return [*labels, OPEN_BIN]


def bin_columns() -> list[str]:
    return [HISTOGRAM_PREFIX + label for label in bin_labels()]


def high_bin_columns(threshold: int = 300) -> list[str]:
    """Bins that start at ``threshold`` or above."""
    return [c for c in bin_columns() if int(c[len(HISTOGRAM_PREFIX) :].split("_")[0]) >= threshold]


def bin_label(fee: Column) -> Column:
    """Label of the bin a fee falls in; null below the first bin. Arithmetic, not a 52-way CASE."""
    expr = F.when(fee >= F.lit(BIN_RUNS[-1][1]), F.lit(OPEN_BIN))
    for start, stop, width in reversed(BIN_RUNS):
        low = (F.floor((fee - start) / width) * width + start).cast("int")
        label = F.concat_ws("_", low.cast("string"), (low + width).cast("string"))
        expr = expr.when((fee >= start) & (fee < stop), label)
    return expr


def bin_start(name: Column) -> Column:
    """Numeric lower edge parsed from a bin's column name (its second-last token)."""
    return F.element_at(F.split(name, "_"), -2).cast("double")


def parse_pairs(text: Column) -> Column:
    """JSON text ``[[fee, count], ...]`` to an array of pairs; an entry that is no list of numbers becomes null,
    a text that is no list becomes a null array."""
    entries = F.from_json(text, "array<string>")
    return F.transform(entries, lambda e: F.from_json(e, "array<double>"))


def pair_histogram(pairs: Column) -> Column:
    """``[[fee, count], ...]`` to a map label -> total count, malformed pairs skipped; null stays null.

    The labelled pairs are bound to a variable: Spark evaluates an expression inside a lambda at each call, so
    the pairs would be parsed and labelled once for each bin.
    """
    good = F.filter(pairs, lambda p: (F.size(p) == 2) & (p[0] >= 1) & p[1].isNotNull())
    labelled = F.transform(
        good, lambda p: F.struct(bin_label(p[0]).alias("label"), p[1].alias("count"))
    )
    labels = F.array(*[F.lit(x) for x in bin_labels()])

    def totals(bound: Column) -> Column:
        return F.transform(
            labels,
            lambda b: F.aggregate(
                F.filter(bound, lambda q: q["label"] == b),
                F.lit(0.0),
                lambda acc, q: acc + q["count"],
            ),
        )

    return F.map_from_arrays(labels, F.transform(F.array(labelled), totals)[0])
