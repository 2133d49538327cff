"""String similarity: normalised indel ratio and its token-set form.

``ratio`` = 200 * LCS / (length of both), 100 for two empty texts. ``ratio_native`` is a pure expression for small inputs;
``ratio`` is an Arrow-batched UDF over a bit-parallel LCS, for volume.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; one big-integer step a character of ``b`` (Hyyro's bit-parallel rule)."""
    if not a or not b:
        return 0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = [indel(one, two)]
    if both:
        found += [indel(both, one), indel(both, two)]
    return max(found)


@F.pandas_udf(DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else token_set(x, y) for x, y in zip(a, b)], dtype="float64")


def can_reach(a: Column, b: Column, least: float) -> Column:
    """Whether the lengths allow a ratio of ``least``: a test to run before the ratio itself."""
    x, y = F.char_length(a), F.char_length(b)
    return 2.0 * F.least(x, y) * 100.0 >= least * (x + y)


def ratio_native(a: Column, b: Column) -> Column:
    """The ratio as a fold over the rows of the LCS table."""
    n, m = F.char_length(a), F.char_length(b)
    start = F.array_repeat(F.lit(0), m + 1)

    def row(before: Column, i: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            hit = F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1))
            value = F.when(hit, F.get(before, j - 1) + 1).otherwise(F.greatest(F.get(before, j), F.element_at(done, -1)))
            return F.concat(done, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), m), F.array(F.lit(0)), cell)

    last = F.element_at(F.aggregate(F.sequence(F.lit(1), n), start, row), -1)
    return F.when(n + m == 0, 100.0).when((n == 0) | (m == 0), 0.0).otherwise(200.0 * last / (n + m))
