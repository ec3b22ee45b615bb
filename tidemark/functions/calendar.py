"""Calendar parts, cyclic encodings, time indices, Fourier terms and trend hinges."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Period of each calendar part; month is used as 1..12, the others from 0.
CYCLES = {"hour": 24, "day_of_week": 7, "month": 12, "minute": 60}

# Seasonal terms of the additive model as (period in days, Fourier order).
SEASONAL_TERMS = {"hourly": (1 / 24, 5), "daily": (1.0, 10), "weekly": (7.0, 5)}


def micros(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))


def slot(ts: str | Column, step_seconds: int) -> Column:
    """Number of whole steps since the epoch: left-closed, left-labelled bins."""
    return F.floor(micros(ts) / F.lit(step_seconds * 1_000_000)).cast("bigint")


def slot_start(s: str | Column, step_seconds: int) -> Column:
    c = F.col(s) if isinstance(s, str) else s
    return F.timestamp_seconds(c * F.lit(step_seconds)).cast("timestamp_ntz")


def calendar_parts(ts: str) -> dict[str, Column]:
    return {
        "hour": F.hour(ts),
        "minute": F.minute(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
    }


def cyclic(ts: str) -> dict[str, Column]:
    """``{part}_sin`` / ``{part}_cos`` for hour, weekday, month and minute."""
    parts = calendar_parts(ts)
    out: dict[str, Column] = {}
    for name, period in CYCLES.items():
        angle = parts[name] * F.lit(2 * math.pi / period)
        out[f"{name}_sin"] = F.sin(angle)
        out[f"{name}_cos"] = F.cos(angle)
    return out


def parse_reference(text: str) -> datetime:
    try:
        return datetime.fromisoformat(text)
    except ValueError as err:
        raise ValueError(f"invalid reference time: {text!r}") from err


def time_index(ts: str, reference: str, step_seconds: int) -> Column:
    """Steps since the reference instant, truncated toward zero."""
    ref = parse_reference(reference)
    zero = int((ref - datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    return ((micros(ts) - F.lit(zero)) / F.lit(step_seconds * 1_000_000)).cast("bigint")


def days(ts: str) -> Column:
    """Time in days since the epoch, the argument of the Fourier terms."""
    return micros(ts) / F.lit(86_400_000_000.0)


def fourier(
    t_days: Column, terms: dict[str, tuple[float, int]] | None = None
) -> dict[str, Column]:
    """``{name}_sin{k}`` / ``{name}_cos{k}`` for every seasonal term and order."""
    out: dict[str, Column] = {}
    for name, (period, order) in (terms or SEASONAL_TERMS).items():
        for k in range(1, order + 1):
            angle = t_days * F.lit(2 * math.pi * k / period)
            out[f"{name}_sin{k}"] = F.sin(angle)
            out[f"{name}_cos{k}"] = F.cos(angle)
    return out


def changepoints(n_changepoints: int, changepoint_range: float) -> list[float]:
    """Changepoint places on a time axis scaled so that the history spans 0..1."""
    return [changepoint_range * j / n_changepoints for j in range(1, n_changepoints + 1)]


def hinges(scaled_t: Column, points: Sequence[float]) -> dict[str, Column]:
    """Piecewise-linear trend: one ``max(0, t - c)`` column per changepoint."""
    return {
        f"hinge_{j}": F.greatest(F.lit(0.0), scaled_t - F.lit(float(c)))
        for j, c in enumerate(points, start=1)
    }
