"""Numeric expressions over topic weights, counts and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy(weights: Column) -> Column:
    """Shannon entropy in nats of an array of probabilities; zero weights add nothing."""
    return F.aggregate(weights, F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log(p)).otherwise(F.lit(0.0)))


def normalized_entropy(weights: Column) -> Column:
    """Entropy over its largest value; 0 for a single weight."""
    return F.when(F.size(weights) > 1, entropy(weights) / F.log(F.size(weights).cast("double"))).otherwise(F.lit(0.0))


def effective_topics(weights: Column) -> Column:
    return F.exp(entropy(weights))


def js_term(p: Column, q: Column) -> Column:
    """One outcome's share of the Jensen-Shannon divergence, base 2."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def js_similarity(divergence: Column) -> Column:
    return 1 - F.sqrt(F.greatest(divergence, F.lit(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either is zero."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pair_jaccard(joint: Column, left: Column, right: Column) -> Column:
    return joint / (left + right - joint)


def pair_npmi(joint: Column, left: Column, right: Column, total: Column) -> Column:
    """Normalized pointwise mutual information; 0 where it has no value."""
    p = joint / total
    value = F.log(p / ((left / total) * (right / total))) / -F.log(p)
    return F.when((p > 0) & (p < 1), value).otherwise(F.lit(0.0))


def edge_weight(count: Column, largest: Column, scale: int = 8) -> Column:
    return F.round(1 + count / largest * scale, 4)


def argmax(weights: Column) -> Column:
    """The first position, from 0, of the largest element."""
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def normalized(weights: Column) -> Column:
    """The array over its sum."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda x: x / total)
