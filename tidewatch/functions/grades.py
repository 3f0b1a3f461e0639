"""Ordered enumerations and guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, worst last.
QUALITIES = ("ok", "stale", "gap_filled", "suspect")
SEVERITIES = ("low", "medium", "high")
KINDS = ("numeric", "categorical", "counter", "telecommand")


def rank_of(value: Column, order: tuple[str, ...] = QUALITIES) -> Column:
    out = F.lit(None).cast("int")
    for k, name in enumerate(order):
        out = F.when(value == name, k).otherwise(out)
    return out


def name_of(rank: Column, order: tuple[str, ...] = QUALITIES) -> Column:
    """Inverse of :func:`rank_of`; null gives the best."""
    return F.element_at(F.array(*[F.lit(x) for x in order]), (F.coalesce(rank, F.lit(0)) + 1).cast("int"))


def severity(peak: Column, medium: Column, high: Column) -> Column:
    return F.when(peak >= high, "high").when(peak >= medium, "medium").otherwise("low")


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b, and ``empty`` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b = F.lit(beta * beta)
    return ratio((1 + b) * precision * recall, b * precision + recall)


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))
