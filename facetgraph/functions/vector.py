"""Vector arithmetic as columns: sums in double, in the order of the elements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _double(x: Column) -> Column:
    return x.cast("double")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: _double(x) * _double(y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (_double(x) - _double(y)) * (_double(x) - _double(y)))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: _double(x) * _double(x))))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: within the functions of arrays an expression is computed again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(a: Column) -> Column:
    """a at length 1; a zero vector stays as it is."""
    divided = lambda v, n: F.when(n > 0, F.transform(v, lambda x: _double(x) / n)).otherwise(F.transform(v, _double))
    return _once(a, lambda v: _once(norm(v), lambda n: divided(v, n)))


def blend(old: Column, new: Column, alpha: float = 0.1) -> Column:
    """The moving average of a centroid, at length 1."""
    return unit(F.zip_with(old, new, lambda x, y: (1 - alpha) * _double(x) + alpha * _double(y)))


def similarity_distance(score: Column) -> Column:
    """Distance of a hit that was ranked by a similarity."""
    return 1 - score


def logits_to_scores(scores: Column) -> Column:
    """Sigmoid of an array of scores, if its first lies outside 0 to 1."""
    outside = (F.get(scores, F.lit(0)) < 0) | (F.get(scores, F.lit(0)) > 1)
    return F.when(outside, F.transform(scores, lambda x: 1 / (1 + F.exp(-_double(x))))).otherwise(F.transform(scores, _double))


def argmax(values: Column) -> Column:
    """Place of the largest value, from 0, the first of equal ones."""
    return F.array_position(values, F.array_max(values)) - 1
