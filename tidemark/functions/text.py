"""Display strings for statistics and column names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_p_value(p: Column) -> Column:
    """``NA`` when unknown, ``<0.0001`` when tiny, else four decimals."""
    return (
        F.when(p.isNull() | F.isnan(p), F.lit("NA"))
        .when(p < 0.0001, F.lit("<0.0001"))
        .otherwise(F.format_string("%.4f", p))
    )


def format_or_insufficient(x: Column, pattern: str = "%.4e") -> Column:
    return F.when(x.isNull(), F.lit("Insufficient Data")).otherwise(F.format_string(pattern, x))


def pretty_label(name: Column, prefix: str, overrides: dict[str, str] | None = None) -> Column:
    """Readable label: an override, else the name without prefix, spaced and capitalised."""
    rest = F.substr(name, F.lit(len(prefix) + 1))
    stripped = F.when(name.startswith(prefix), rest).otherwise(name)
    auto = F.initcap(F.replace(stripped, F.lit("_"), F.lit(" ")))
    if not overrides:
        return auto
    table = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    return F.coalesce(F.element_at(table, name), auto)
