"""Similarities of strings: token Jaccard in the JVM, Jaro-Winkler as a vectorised UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def jaccard(a: Column, b: Column) -> Column:
    """Shared distinct tokens in per cent of all, one decimal; null if either is null."""
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return F.round(100.0 * F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), 1)


def jaro_winkler_score(a: str | None, b: str | None, boost: float = 0.7) -> float | None:
    """Jaro-Winkler of 0 to 1; the prefix counts only above ``boost``. Two empty strings are equal."""
    if a is None or b is None:
        return None
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    reach = max(max(n, m) // 2 - 1, 0)
    taken, hits = [False] * m, []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(m, i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                hits.append(x)
                break
    if not hits:
        return 0.0
    others = [b[j] for j in range(m) if taken[j]]
    k = len(hits)
    t = sum(x != y for x, y in zip(hits, others)) // 2
    jaro = (k / n + k / m + (k - t) / k) / 3
    if jaro <= boost:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def jaro_winkler(a: Column, b: Column, boost: float = 0.7) -> Column:
    """Arrow-batched :func:`jaro_winkler_score`; equal pairs of a batch are scored once."""

    @pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known[p] if p in known else known.setdefault(p, jaro_winkler_score(*p, boost)) for p in zip(x, y)])

    return score(a, b)
