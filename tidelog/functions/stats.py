"""Statistics as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Median absolute deviation to standard deviation, least scale, severity names by rank.
MAD_SCALE, LEAST_SCALE = 1.4826, 1e-9
SEVERITIES = ("normal", "elevated", "anomalous", "critical")


def robust_z(x: Column, centre: Column, spread: Column) -> Column:
    """(x - median) / max(1.4826 |spread|, 1e-9)."""
    return (x - centre) / F.greatest(F.lit(MAD_SCALE) * F.abs(spread), F.lit(LEAST_SCALE))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Pooled two-proportion z; null without samples, 0 without variance."""
    pool = (k1 + k2) / (n1 + n2)
    variance = pool * (1 - pool) * (1 / n1 + 1 / n2)
    return F.when((n1 > 0) & (n2 > 0), F.when(variance <= 0, F.lit(0.0)).otherwise((k1 / n1 - k2 / n2) / F.sqrt(variance)))


def severity(z: Column, elevated: float, anomalous: float, critical: float) -> Column:
    return F.when(z >= critical, "critical").when(z >= anomalous, "anomalous").when(z >= elevated, "elevated").otherwise("normal")


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), name).cast("int") - 1


def hour_of_week(ts: Column) -> Column:
    """0..167, Monday 00:00 first."""
    return F.weekday(ts) * 24 + F.hour(ts)


def sorted_median(values: Column) -> Column:
    """Mean of the middle two of an array; null if empty."""
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.element_at(s, i.cast("int"))
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2.0)


def sorted_mad(values: Column, centre: Column) -> Column:
    return sorted_median(F.transform(values, lambda v: F.abs(v - centre)))
