"""Scalar functions of scores and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -40.0, 40.0)))


def logit(p: Column) -> Column:
    q = clip(p, EPSILON, 1 - EPSILON)
    return F.ln(q / (1 - q))


def logit_mean(p: Column, q: Column) -> Column:
    return sigmoid((logit(p) + logit(q)) / 2)


def log_sum_exp(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.ln(F.exp(a - top) + F.exp(b - top))


def two_class_probability(zero: Column, one: Column) -> Column:
    """Softmax probability of the second of two log-probabilities."""
    return F.exp(one - log_sum_exp(zero, one))


def finite_or_zero(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def bins(c: Column, edges: list[float], labels: list[str]) -> Column:
    """Left-open, right-closed bins: label k for edges[k-1] < c <= edges[k]; the last label is open above."""
    out = F.lit(labels[-1])
    for edge, label in reversed(list(zip(edges, labels, strict=False))):
        out = F.when(c <= edge, F.lit(label)).otherwise(out)
    return F.when(c.isNotNull(), out)


def candidate_count_bucket(c: Column) -> Column:
    return bins(c, [50, 100, 150, 300], ["<=50", "51-100", "101-150", "151-300", ">300"])


def half_even(c: Column) -> Column:
    return F.bround(c, 0).cast("long")
