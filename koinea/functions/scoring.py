"""Numeric expressions: gates, scaling, means and soft-weighted aggregates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gate(distance: Column, threshold: float, k: float = 20.0) -> Column:
    """Logistic gate 1 / (1 + exp(-k (threshold - distance)))."""
    return 1.0 / (1.0 + F.exp(-F.lit(float(k)) * (F.lit(float(threshold)) - distance)))


def power_scale(p: Column, most: float = 1.0, alpha: float = 5.0) -> Column:
    """(p / most) ** alpha."""
    return F.pow(p / F.lit(float(most)), F.lit(float(alpha)))


def sigmoid(x: Column) -> Column:
    """Logistic function."""
    return 1.0 / (1.0 + F.exp(-x))


def freq_softmax(distance: Column, freq: Column, lowest: Column, temperature: float = 5.0) -> Column:
    """Aggregate: mean distance weighted by freq * softmax(-temperature * distance).

    The softmax denominator cancels; ``lowest`` (the group's minimum) keeps exp() in range. Null if the
    group is empty or its frequencies sum to 0; the plain mean if only the weights vanish.
    """
    weight = freq * F.exp(F.lit(-float(temperature)) * (distance - lowest))
    total = F.sum(weight)
    return F.when(F.sum(freq) == 0, F.lit(None).cast("double")).when(total == 0, F.avg(distance)).otherwise(F.sum(weight * distance) / F.nullif(total, F.lit(0.0)))


def gated_mean(distance: Column, threshold: float, k: float = 20.0, slots: int | None = None) -> Column:
    """Aggregate: mean of gates, a missing distance counting as 1.0; over a fixed number of slots if given, absent rows as distance 1."""
    gated = gate(F.coalesce(distance, F.lit(1.0)), threshold, k)
    if slots is None:
        return F.avg(gated)
    return (F.sum(gated) + (F.lit(slots) - F.count("*")) * gate(F.lit(1.0), threshold, k)) / F.lit(float(slots))


def harmonic_mean(x: Column, floor: float = 1e-6) -> Column:
    """Aggregate: n / sum(1 / max(x, floor))."""
    return F.count(x) / F.sum(1.0 / F.greatest(x, F.lit(floor)))


def generalized_harmonic_mean(x: Column, p: float = 2.0, eps: float = 1e-8) -> Column:
    """Aggregate: (mean of (x + eps) ** -p) ** (-1 / p); null for no values."""
    return F.pow(F.avg(F.pow(x + F.lit(eps), F.lit(-p))), F.lit(-1.0 / p))


def rmse(gold: Column, predicted: Column) -> Column:
    """Aggregate: root of the mean squared error."""
    return F.sqrt(F.avg(F.pow(gold - predicted, F.lit(2.0))))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole with a zero or missing whole counting as 1."""
    return part / F.coalesce(F.nullif(whole, F.lit(0)), F.lit(1))
