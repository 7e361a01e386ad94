"""Name similarity: ratio of the longest common subsequence on token-sorted names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadmill import lexicons as lx


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel longest common subsequence (Crochemore et al. 2001)."""
    if not a or not b:
        return 0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


# else Spark moves a filter on it below a distinct() or a join, and calls it there for every repeated pair
lcs_udf = lcs_udf.asNondeterministic()


def max_edits(l1: Column, l2: Column) -> Column:
    """Most insertions plus deletions two names of these lengths may differ by."""
    return F.floor((100 - lx.FUZZY_PERCENT) * (l1 + l2) / F.lit(100)).cast("int")


def is_similar(lcs: Column, l1: Column, l2: Column) -> Column:
    """200·LCS / (l1+l2) >= threshold, in integers."""
    return 200 * lcs >= lx.FUZZY_PERCENT * (l1 + l2)
