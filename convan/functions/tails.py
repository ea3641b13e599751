"""Tails of exact tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


EXACT = 1_000  # coins up to which the tail is a quotient of whole numbers


def binomial_tail(k: int, n: int) -> float:
    """The two-sided exact p of k of n fair coins, k at most n / 2: terms from k down until they no longer count.

    Of few coins p may lie just halfway between two numbers of six digits (9 / 128), so there the quotient is exact."""
    if n == 0:
        return 1.0
    if n <= EXACT:
        return min(1.0, sum(math.comb(n, i) for i in range(k + 1)) / 2 ** (n - 1))
    ratio, total, i = 1.0, 1.0, k
    while i > 0 and ratio > total * 1e-17:
        ratio *= i / (n - i + 1)
        total += ratio
        i -= 1
    return min(1.0, 2 * math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) * total)


def mcnemar_p(a: Column | str, b: Column | str) -> Column:
    """The exact two-sided p of two discordant counts; nulls count as 0. Its memory does not grow with the counts, its steps with the root of their sum."""

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([binomial_tail(int(min(x, y)), int(x + y)) for x, y in zip(a.fillna(0), b.fillna(0), strict=True)], dtype="float64")

    return p(a, b)
