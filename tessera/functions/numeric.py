"""Arithmetic, binning, rounding and distances, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.009


def fix_floating(floor: Column, total: Column) -> Column:
    """Twice the floor as the number of floors where a floor lies above the last."""
    return F.when(floor > total, floor * 2).otherwise(total)


def price_to_log(price: Column) -> Column:
    return F.log1p(price)


def log_to_price(log_price: Column) -> Column:
    """Whole prices, half to even."""
    return F.bround(F.expm1(log_price), 0)


def cut(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the right-closed interval; NULL at or below the first edge. The last is open to the right."""
    out = F.when(value <= edges[0], F.lit(None).cast("string"))
    for edge, label in zip(edges[1:], labels):
        out = out.when(value <= edge, label)
    return out.when(value > edges[len(labels) - 1], labels[-1]) if len(edges) == len(labels) else out


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def hub_distance(x: Column, y: Column, hub_x: Column, hub_y: Column, low: float = -1.0, high: float = 0.25) -> Column:
    """Clipped distance in degrees."""
    return clip(F.sqrt(F.pow(x - hub_x, 2) + F.pow(y - hub_y, 2)), low, high)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def flip_score(score: Column, label: Column, first_label: str) -> Column:
    """The score of the first of two labels, from the score of the label that won."""
    return F.when(label == first_label, score).otherwise(1 - score)


def row_mean(*columns: Column) -> Column:
    """Mean of the values that aren't NULL; NULL without any."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    return total / F.nullif(sum((c.isNotNull().cast("int") for c in columns), F.lit(0)), F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole, F.lit(0))


def backoff(attempt: Column, base: float = 2.5, most: float | None = None) -> Column:
    """Seconds before the next attempt, without the random part."""
    wait = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    return wait if most is None else F.least(wait, F.lit(most))
