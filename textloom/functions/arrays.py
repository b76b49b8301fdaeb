"""Numeric functions over arrays of logits, labels and masks; no row is shuffled."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda s, x: s + x)


def logsumexp(logits: Column) -> Column:
    """log of the sum of exponentials, shifted by the maximum; null for an empty array."""
    return let(F.array_max(logits).cast("double"), lambda top: F.log(total(F.transform(logits, lambda x: F.exp(x - top)))) + top)


def log_softmax(logits: Column) -> Column:
    return let(logsumexp(logits), lambda z: F.transform(logits, lambda x: x - z))


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), F.exp)


def cross_entropy(logits: Column, label: Column) -> Column:
    """-log p of the label at one position (labels count from 0)."""
    return logsumexp(logits) - F.get(logits, label.cast("int")).cast("double")


def kl_divergence(student: Column, teacher: Column) -> Column:
    """Sum over the vocabulary of p_t (log p_t - log p_s) at one position."""
    pairs = lambda zs: lambda zt: total(F.zip_with(student, teacher, lambda s, t: F.exp(t - zt) * ((t - zt) - (s - zs))))
    return let(logsumexp(student), lambda zs: let(logsumexp(teacher), pairs(zs)))


def shifted_labels(labels: Column) -> Column:
    """The targets of causal training: position i is to predict label i + 1, the last nothing."""
    return F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))


def shifted_inputs(ids: Column) -> Column:
    return F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0)))


def real_tokens(mask: Column) -> Column:
    """Number of real tokens of an attention mask."""
    return F.aggregate(mask, F.lit(0).cast("bigint"), lambda s, x: s + x)


def without(ids: Column, pad: int) -> Column:
    return F.array_remove(ids, pad)


def shrink(size: Column, factor: Column) -> Column:
    """A student's number of layers or units: the teacher's divided by factor, at least 1."""
    return F.greatest(F.lit(1), F.floor(size / factor)).cast("bigint")
