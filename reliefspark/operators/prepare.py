"""Preparation of a raw grid: NoData values and void filling."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tiles import bounds_of
from . import kernels as K
from . import relational as R

#: Longest side of the overview that fills voids; it bounds what is gathered and broadcast.
COARSE = 2048


def nodata_option(text: str | float | None) -> tuple[float | None, bool]:
    """The forced value, and whether undeclared values are looked for."""
    said = "auto" if text is None else str(text).strip().lower()
    if said in ("", "auto"):
        return None, True
    if said in ("none", "off", "nan"):
        return None, False
    return float(said), False


def border_value(grid: DataFrame, ring_share: float = 0.5, share: float = 0.02) -> DataFrame:
    """The border's most frequent value where it rules the border; no row otherwise, or below 8 x 8."""
    ends = grid.agg((F.max("r") - F.min("r")).alias("h"), (F.max("c") - F.min("c")).alias("w"), F.count("*").alias("all"))
    ring = R._border(grid).where((F.col("r1") - F.col("r0") >= 7) & (F.col("c1") - F.col("c0") >= 7))
    top = ring.where("z IS NOT NULL").groupBy("z").count().orderBy(F.desc("count"), "z").limit(1)
    total = ring.agg(F.count("*").alias("ring"))
    whole = grid.join(F.broadcast(top.select("z")), "z").agg(F.count("*").alias("held"))
    near = top.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(ends))  # one row each
    return near.where((F.col("count") >= ring_share * F.col("ring")) & (F.col("held") >= share * F.col("all"))).select("z", "count", "ring")


def without_nodata(grid: DataFrame, nodata: str | float | None = "auto", ring_share: float = 0.5, sentinel_share: float = 0.05) -> DataFrame:
    """NaN, infinite, forced and inferred NoData values as NULL.

    Inferred are a dominant sentinel and the border's ruling value; without either, values
    that are customary for NoData and not rare are warned of.
    """
    forced, look = nodata_option(nodata)
    z = F.col("z").cast("double")
    clean = grid.withColumn("z", F.when(~(F.isnan(z) | (F.abs(z) == float("inf"))), z))
    values = [] if forced is None else [forced]
    if look:
        values += [row["z"] for found in (R.sentinel(clean, sentinel_share), border_value(clean, ring_share)) for row in found.collect()]  # one row at most each
        if not values and (seen := R.implicit_nodata(clean).collect()):
            warnings.warn("values that look like NoData stay: " + ", ".join(f"{r['z']:g} ({r['share']:.1%})" for r in seen), stacklevel=2)
    for v in values:
        clean = clean.withColumn("z", F.when(F.abs(F.col("z") - v) > 1e-8 + 1e-5 * abs(v), F.col("z")))
    return clean


def prepare(grid: DataFrame, fill: str = "enclosed", nodata: str | float | None = "auto", coarse: int = COARSE, **shares: float) -> DataFrame:
    """r, c, z with voids filled: `enclosed` ones, `all`, or `none`.

    The filling surface is a push-pull pyramid over an overview of at most `coarse` cells
    a side, which is also the most that is gathered and broadcast; pixels sample it. A grid
    without voids comes back as it is.
    """
    if fill not in ("enclosed", "all", "none"):
        raise ValueError(f"fill mode {fill!r}")
    clean = without_nodata(grid.select("r", "c", "z"), nodata, **shares)
    bounds = bounds_of(clean)
    if fill == "none" or bounds is None or clean.where("z IS NULL").isEmpty():
        return clean
    factor = max(1, -(-max(bounds.shape) // coarse))
    shifted = clean.select((F.col("r") - bounds.r0).alias("r"), (F.col("c") - bounds.c0).alias("c"), "z")
    cells = R.coarsen(shifted, factor).toPandas()
    z = np.full(tuple(-(-n // factor) for n in bounds.shape), np.nan)
    z[cells.r, cells.c] = cells.z.astype(float)
    held = clean.sparkSession.sparkContext.broadcast((K.push_pull(z), K.exterior(z).astype(float)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surface, outside = held.value
        for b in batches:
            y, x = ((b[k].to_numpy(float) - first + 0.5) / factor - 0.5 for k, first in (("r", bounds.r0), ("c", bounds.c0)))
            new = K.bilinear(surface, y, x)
            if fill == "enclosed":
                new = np.where(K.bilinear(outside, y, x) > 0.5, np.nan, new)
            elif not np.isfinite(new).all():
                raise ValueError("voids are left after filling all of them")
            yield pd.DataFrame({"r": b.r, "c": b.c, "z": np.where(b.z.isna(), new, b.z.astype(float))})

    out = clean.where("z IS NULL").mapInPandas(work, "r long, c long, z double").withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    return clean.where("z IS NOT NULL").select(F.col("r").cast("long"), F.col("c").cast("long"), "z").unionByName(out)
