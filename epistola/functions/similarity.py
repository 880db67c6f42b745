"""String similarities that Spark lacks, as Arrow functions for the few pairs that reach them."""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler with half transpositions kept, a prefix of four at most and the boost always applied."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(max(len(a), len(b)) // 2 - 1, 0)
    taken = [False] * len(b)
    mine = []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    m, half = len(mine), sum(x != y for x, y in zip(mine, theirs)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def _lev(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def parts_distance(a: list[str], b: list[str]) -> int:
    """Least sum of part distances over all ways to pair the parts of two lists of one length. Up to six parts all orders are tried, beyond by
    an exact assignment over subsets."""
    n = len(a)
    cost = [[_lev(x, y) for y in b] for x in a]
    if n <= 6:
        return min(sum(cost[i][p[i]] for i in range(n)) for p in permutations(range(n)))
    best = {0: 0}
    for i in range(n):
        nxt: dict[int, int] = {}
        for mask, c in best.items():
            for j in range(n):
                if not mask >> j & 1 and (d := c + cost[i][j]) < nxt.get(mask | 1 << j, 1 << 30):
                    nxt[mask | 1 << j] = d
        best = nxt
    return best[(1 << n) - 1]


@F.pandas_udf(T.IntegerType())
def parts_distance_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([parts_distance(list(x), list(y)) for x, y in zip(a, b)], dtype="int32")
