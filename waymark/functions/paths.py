"""Predicates and folds over a path's list columns, all JVM-side.

Lists hold one value per edge, in path order. A null list element never makes a
predicate null: comparisons with it count as false unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def positions(xs: Column) -> Column:
    """1 .. size - 1; empty for shorter lists (sequence() would count down)."""
    return F.when(F.size(xs) > 1, F.sequence(F.lit(1), F.size(xs) - 1)).otherwise(F.array().cast("array<int>"))


def is_trail(ids: Column) -> Column:
    """No edge occurs twice."""
    return F.size(F.array_distinct(ids)) == F.size(ids)


def any_adjacent_equal(xs: Column) -> Column:
    return F.exists(positions(xs), lambda i: F.coalesce(F.get(xs, i) == F.get(xs, i - 1), F.lit(False)))


def strictly_increasing(xs: Column) -> Column:
    """No element is as small as its predecessor; nulls don't break the order."""
    return F.forall(positions(xs), lambda i: F.coalesce(F.get(xs, i) > F.get(xs, i - 1), F.lit(True)))


def spread_at_most(xs: Column, bound: float, inclusive: bool = True) -> Column:
    spread = F.array_max(xs) - F.array_min(xs)
    return spread <= bound if inclusive else spread < bound


def all_same(xs: Column) -> Column:
    """At most one distinct value; nulls don't count."""
    return F.size(F.array_distinct(F.array_compact(xs))) <= 1


def total(xs: Column) -> Column:
    """Sum by a left fold from 0."""
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def last(xs: Column) -> Column:
    return F.try_element_at(xs, F.lit(-1))


def reduce_first(xs: Column, f) -> Column:
    """A fold whose seed is the first element; null once an element is null, and for empty lists."""
    return F.when(F.size(xs) > 0, F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.get(xs, F.lit(0)), f))
