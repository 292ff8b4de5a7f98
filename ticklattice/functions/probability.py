"""Tail probabilities of test statistics, for results of a few rows."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs up to which the signed-rank distribution and the binomial are summed exactly.
EXACT_RANKS, EXACT_TRIALS = 50, 10_000


def two_sided(z: Column) -> Column:
    """Chance that a standard normal value is at least as far from 0 as ``z``."""

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else math.erfc(abs(v) / math.sqrt(2)))

    return tail(z)


def signed_rank_tail(n: int, w: float) -> float:
    """Two-sided chance of a signed-rank sum at most ``w`` (the smaller of the two), without ties: subsets of 1..n by their sum."""
    ways = [1] + [0] * (n * (n + 1) // 2)
    for k in range(1, n + 1):
        for s in range(k * (k + 1) // 2, k - 1, -1):
            ways[s] += ways[s - k]
    return min(1.0, 2 * sum(ways[: math.floor(w) + 1]) / 2**n)


def sign_tail(few: int, n: int) -> float:
    """Two-sided chance of at most ``few`` heads in ``n`` fair tosses."""
    if not n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2) for k in range(few + 1)]
    top = max(logs)
    return min(1.0, 2 * math.exp(top) * sum(math.exp(x - top) for x in logs))


def signed_rank_p(n: Column, w: Column, tied: Column, z: Column) -> Column:
    """Exact for up to EXACT_RANKS pairs without ties, else by the normal ``z``."""

    @F.pandas_udf("double")
    def p(n: pd.Series, w: pd.Series, tied: pd.Series, z: pd.Series) -> pd.Series:
        def one(n, w, tied, z):
            if not n:
                return None
            if n <= EXACT_RANKS and not tied:
                return signed_rank_tail(int(n), w)
            return None if pd.isna(z) else math.erfc(abs(z) / math.sqrt(2))

        return pd.Series([one(*x) for x in zip(n, w, tied, z, strict=True)], dtype="float64")

    return p(n, w, tied, z)


def sign_p(few: Column, n: Column, chi_square: Column) -> Column:
    """Exact for up to EXACT_TRIALS tosses, else by the chi-square statistic of one degree of freedom."""

    @F.pandas_udf("double")
    def p(few: pd.Series, n: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([sign_tail(int(a), int(b)) if b <= EXACT_TRIALS else math.erfc(math.sqrt(y / 2)) for a, b, y in zip(few, n, x, strict=True)], dtype="float64")

    return p(few, n, chi_square)
