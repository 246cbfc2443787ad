"""Array and probability functions on logits, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / total(powers))


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    shift = top + F.log(total(F.transform(logits, lambda x: F.exp(x - top))))
    return F.transform(logits, lambda x: x - shift)


def expected_value(logits: Column) -> Column:
    """Sum of class number times probability."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.try_divide(total(F.transform(powers, lambda x, i: x * i)), total(powers))


def argmax(a: Column) -> Column:
    """Place of the first maximum, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def hierarchical(binary_logits: Column, child_logits: Column) -> Column:
    """Log probabilities of class 0 and of the children, from a zero-or-not head and a head over the children."""
    head, child = log_softmax(binary_logits), log_softmax(child_logits)
    return F.concat(F.array(head[0]), F.transform(child, lambda x: x + head[1]))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n neighbouring tokens; none where there are fewer."""
    return F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, n))).otherwise(F.array().cast("array<array<string>>"))
