"""Exact percentiles of large columns by narrowing histograms.

Spark's exact percentile keeps every distinct value in one task. Here a rank is found by
counting values in BINS equal steps between the bounds, then within the step that holds
the rank, and so on, until at most FEW values are left to fetch. Every pass is an
aggregation with map-side sums; results interpolate linearly between ranks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of a histogram, and values that may be fetched at last.
BINS, FEW = 4096, 20_000


def quantiles(df: DataFrame, x: Column, shares: list[float]) -> list[float | None]:
    """The percentiles (shares from 0 to 1) of the non-null values of x; None where there are none."""
    df = df.select(x.cast("double").alias("x")).where("x IS NOT NULL")
    n, low, high = df.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return [None] * len(shares)
    ends = [(math.floor(q * (n - 1)), math.ceil(q * (n - 1)), q * (n - 1)) for q in shares]
    at = _ranked(df, sorted({r for a, b, _ in ends for r in (a, b)}), n, low, high)
    return [at[a] + (at[b] - at[a]) * (place - a) for a, b, place in ends]


def _ranked(df: DataFrame, ranks: list[int], n: int, low: float, high: float) -> dict[int, float]:
    """The values at ranks (from 0) of n values between low and high."""
    found: dict[int, float] = {}
    todo, few = [(low, high, 0, n, ranks)], []  # bounds, rank of the first value, number of values, ranks wanted
    while todo:
        low, high, first, n, wanted = todo.pop()
        if low == high:
            found |= {r: low for r in wanted}
        elif n <= FEW:
            few.append((low, high, first, wanted))
        else:
            step = F.least(F.floor((F.col("x") - low) / ((high - low) / BINS)), F.lit(BINS - 1))
            counts = df.where(F.col("x").between(low, high)).groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
            for row in sorted(counts.collect(), key=lambda row: row["step"]):  # at most BINS rows
                inside = [r for r in wanted if first <= r < first + row["n"]]
                if inside:
                    todo.append((row["low"], row["high"], first, row["n"], inside))
                first += row["n"]
    if few:
        near = [F.col("x").between(low, high) for low, high, _, _ in few]
        any_of = near[0]
        for other in near[1:]:
            any_of = any_of | other
        values = sorted(row["x"] for row in df.where(any_of).collect())  # at most FEW for each range
        for low, high, first, wanted in few:
            own = [v for v in values if low <= v <= high]
            found |= {r: own[r - first] for r in wanted}
    return found
