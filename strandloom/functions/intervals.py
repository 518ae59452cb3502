"""Closed-interval algebra as column expressions: an interval `[st, ed]` has `ed - st + 1` places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(st: Column, ed: Column) -> Column:
    return ed - st + 1


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= e2) & (s2 <= e1)


def within(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The first lies in the second."""
    return (s2 <= s1) & (e1 <= e2)


def union(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.struct(F.least(s1, s2).alias("st"), F.greatest(e1, e2).alias("ed"))


def intersection(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Null if they are apart."""
    return F.when(overlaps(s1, e1, s2, e2), F.struct(F.greatest(s1, s2).alias("st"), F.least(e1, e2).alias("ed")))


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Places in both, also for nested intervals; 0 if they are apart."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def overlap_share(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Overlap by the longer length."""
    return overlap_length(s1, e1, s2, e2) / F.greatest(length(s1, e1), length(s2, e2))
