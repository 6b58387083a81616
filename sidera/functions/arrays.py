"""Functions of ordered lists and vectors, Column to Column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def tail(c: Column, n: int) -> Column:
    """The last n elements, or all of a shorter list."""
    return F.slice(c, F.greatest(F.lit(1), F.size(c) - n + 1), F.lit(n))


def forward_pairs(c: Column, window: int) -> Column:
    """(i, j) of each element with each of the `window` after it, in order."""
    def of(i: Column) -> Column:
        last = F.least(i + window, F.size(c) - 1)
        return F.transform(F.sequence(i + 1, last), lambda j: F.struct(F.get(c, i).alias("sid_i"), F.get(c, j).alias("sid_j")))

    pairs = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - 2, F.lit(0))), of))
    return F.when(F.size(c) >= 2, pairs).otherwise(F.slice(F.arrays_zip(c.alias("sid_i"), c.alias("sid_j")), 1, 0))


def split_points(c: Column) -> Column:
    """2 .. length - 1: how long a history may be that leaves a target."""
    return F.when(F.size(c) >= 3, F.sequence(F.lit(2), F.size(c) - 1)).otherwise(F.array().cast("array<int>"))


def others(c: Column, one: Column, n: int = 5) -> Column:
    return F.slice(F.filter(c, lambda s: s != one), 1, n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: x.cast("double") / size)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def set_f1(pred: Column, gold: Column) -> Column:
    """F1 of two token sets; 0 if either is empty."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    both = F.size(F.array_intersect(p, g))
    return F.when((F.size(p) == 0) | (F.size(g) == 0) | (both == 0), 0.0).otherwise(2.0 * both / (F.size(p) + F.size(g)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; both empty is 1, one empty 0."""
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / n)


@pandas_udf(T.DoubleType())
def _char_f1(a: pd.Series, b: pd.Series) -> pd.Series:
    def f1(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x or not y:
            return float(x == y)
        return 2.0 * sum(min(x.count(ch), y.count(ch)) for ch in set(x) & set(y)) / (len(x) + len(y))

    return pd.Series([f1(x, y) for x, y in zip(a, b)], dtype=object).astype("Float64")


def char_f1(a: Column, b: Column) -> Column:
    """F1 of two multisets of characters without white space; both empty is 1, one empty 0."""
    return _char_f1(*(F.regexp_replace(F.lower(c), r"(?U)\s+", "") for c in (a, b)))
