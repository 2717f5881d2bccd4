"""Reducers with the NaN, NULL and zero rules of the summaries, pass@k, accuracy and similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _known(x: Column | str) -> Column:
    return F.nanvl(F.col(x).cast("double") if isinstance(x, str) else x.cast("double"), F.lit(None).cast("double"))


def nan_sum(x: str) -> Column:
    """Sum without NaN and NULL; 0 if nothing is left. Whole-number columns give a long."""
    return F.coalesce(F.sum(_known(x)), F.lit(0.0))


def long_sum(x: str) -> Column:
    return F.coalesce(F.sum(F.col(x)), F.lit(0)).cast("long")


def nan_mean(x: str) -> Column:
    """Mean without NaN and NULL; NaN if nothing is left."""
    return F.coalesce(F.avg(_known(x)), F.lit(NAN))


def truthy(x: str | Column) -> Column:
    """How many rows are true."""
    return F.count_if(F.col(x) if isinstance(x, str) else x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NaN for a zero denominator."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(NAN))


def weighted_mean(x: str, weight: str) -> Column:
    """Mean weighted by counts; a NaN value propagates, and no weight at all gives NaN."""
    return ratio(F.sum(F.col(x) * F.col(weight)), F.sum(weight))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Chance that one of k draws from n, c of them right, is right; 1 where fewer than k are wrong."""
    wrong = n - c
    product = F.aggregate(F.sequence(wrong + 1, n), F.lit(1.0), lambda p, i: p * (1 - F.lit(float(k)) / i))
    return F.when(wrong < k, F.lit(1.0)).when(c <= 0, F.lit(0.0)).otherwise(1 - product)


def positional_accuracy(a: Column, b: Column) -> Column:
    """Share of equal positions of two arrays, the shorter padded with what equals nothing; NaN if both are empty."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int")), F.lit(0), lambda s, x: s + x)
    return ratio(same, F.greatest(F.size(a), F.size(b)))


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit for each character of a."""
    if len(a) > len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_similarity(a: str, b: str) -> float:
    """2 * LCS / (len(a) + len(b)); 1 for two empty strings."""
    return 2 * lcs_length(a, b) / (len(a) + len(b)) if a or b else 1.0


def _ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for one, two in pairs:
        yield pd.Series([None if a is None or b is None else indel_similarity(a, b) for a, b in zip(one, two, strict=True)], dtype="float64")


def indel_ratio(one: Column | str, two: Column | str) -> Column:
    """indel_similarity by rows; NULL where either side is NULL."""
    return F.pandas_udf(_ratios, "double")(one, two)
