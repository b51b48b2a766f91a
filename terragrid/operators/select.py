"""Exact order statistics of a column without gathering it in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: values that may come to the driver once a rank is narrowed down to them
FEW = 1 << 14


def order_statistics(df: DataFrame, value: str, first: int, last: int, n: int, low: float, high: float) -> list[float]:
    """The values of ranks ``first`` to ``last`` (from 0) of n values from ``low`` to ``high``.

    The range is narrowed by approximate percentiles around the ranks, each pass an aggregate that
    combines before the shuffle, until few values are left in it.  A bound that turns out wrong is
    not taken.
    """
    c, below, inside = F.col(value), 0, n
    while low < high and inside > FEW:
        slack = max(2.0, inside / 2000)
        at = [max(0.0, (first - below - slack) / inside), min(1.0, (last - below + slack) / inside)]
        part = df.where(c.between(low, high))
        a, b = part.agg(F.percentile_approx(c, at, 10000)).first()[0]
        under, upto = part.agg(F.count_if(c < a), F.count_if(c <= b)).first()
        take_low, take_high = below + under <= first and a > low, below + upto > last and b < high
        if not (take_low or take_high):
            # no progress by ranks: halve by value
            mid = low + (high - low) / 2
            n_mid = part.where(c <= mid).count()
            if below + n_mid > last:
                high, inside = mid, n_mid
            elif below + n_mid <= first:
                low, below, inside = math.nextafter(mid, math.inf), below + n_mid, inside - n_mid
            else:
                return [order_statistics(df, value, r, r, n, low, high)[0] if not below else order_statistics(part, value, r - below, r - below, inside, low, high)[0] for r in range(first, last + 1)]
            continue
        inside = (upto if take_high else inside) - (under if take_low else 0)
        if take_low:
            low, below = a, below + under
        if take_high:
            high = b
    if low == high:
        return [low] * (last - first + 1)
    rows = sorted(r[0] for r in df.where(c.between(low, high)).select(c).collect())  # few
    return rows[first - below : last - below + 1]


def percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation; nulls and NaN don't count, no values give None."""
    df = df.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = df.agg(F.count("v"), F.min("v"), F.max("v")).first()
    out: list[float | None] = []
    for p in shares:
        if not n:
            out.append(None)
            continue
        at = p * (n - 1)
        k = int(at)
        got = order_statistics(df, "v", k, min(k + 1, n - 1), n, low, high)
        out.append(got[0] + (got[-1] - got[0]) * (at - k))
    return out
