"""Neighbourhood expressions over pixel rows: shifts, gradients, Gaussians, box means."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def along_row() -> WindowSpec:
    return Window.partitionBy("r").orderBy("c")


def along_column() -> WindowSpec:
    return Window.partitionBy("c").orderBy("r")


def complete(grid: DataFrame) -> tuple[DataFrame, dict]:
    """A row for each pixel of the raster, and the raster's bounds (r0, r1, c0, c1) and number of voids.

    Windows count rows, so pixels that have no row must get one. `here` tells the given
    ones, which alone belong to a result.
    """
    ends = grid.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"), F.count("z").alias("valid")).first().asDict()
    grid = grid.withColumn("here", F.lit(True))
    if not ends["n"]:
        return grid, ends | {"voids": 0, "cells": 0}
    h, w = ends["r1"] - ends["r0"] + 1, ends["c1"] - ends["c0"] + 1
    if ends["n"] < h * w:
        every = grid.sparkSession.range(h * w).select((F.floor(F.col("id") / w) + ends["r0"]).cast("long").alias("r"), (F.col("id") % w + ends["c0"]).alias("c"))
        grid = every.join(grid, ["r", "c"], "left").withColumn("here", F.col("here").isNotNull())
    return grid, ends | {"voids": h * w - ends["valid"], "cells": h * w}


def derivative(value: Column, order: WindowSpec, step: float = 1.0) -> Column:
    """Central difference, second-order one-sided at both ends; of two cells their difference, of one 0."""
    ahead, behind = F.lead(value, 1).over(order), F.lag(value, 1).over(order)
    first, last = F.row_number().over(order) == 1, F.lead(F.lit(1), 1).over(order).isNull()
    at_start = F.coalesce((-3 * value + 4 * ahead - F.lead(value, 2).over(order)) / (2 * step), (ahead - value) / step, F.lit(0.0))
    at_end = F.coalesce((3 * value - 4 * behind + F.lag(value, 2).over(order)) / (2 * step), (value - behind) / step)
    return F.when(first, at_start).when(last, at_end).otherwise((ahead - behind) / (2 * step))


def _weighed(name: str, order: WindowSpec, weights: list[float]) -> Column:
    """Weighted sum of a column's neighbours; beyond both ends the end cell is repeated."""
    n, value = len(weights) // 2, F.col(name)
    first = F.first(value).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # of the whole line, which is read once; a frame from the current row on would be read again for every row
    last = F.last(value).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = value * weights[n]
    for k in range(1, n + 1):
        out = out + F.coalesce(F.lag(value, k).over(order), first) * weights[n - k] + F.coalesce(F.lead(value, k).over(order), last) * weights[n + k]
    return out


def gaussian(sigma: float) -> list[float]:
    n = int(4 * sigma + 0.5)
    w = [math.exp(-(k**2) / (2 * sigma**2)) for k in range(-n, n + 1)]
    return [x / sum(w) for x in w]


def valid_gauss(grid: DataFrame, sigma: float, name: str) -> DataFrame:
    """Adds the Gaussian of valid cells by their weight, 0 where none reaches; the grid must be complete."""
    w = gaussian(sigma)
    out = grid.withColumns({"__s": F.coalesce("z", F.lit(0.0)), "__n": F.col("z").isNotNull().cast("double")})
    for order in (along_row(), along_column()):
        out = out.withColumns({x: _weighed(x, order, w) for x in ("__s", "__n")})
    return out.withColumn(name, F.when(F.col("__n") > 0, F.col("__s") / F.col("__n")).otherwise(0.0)).drop("__s", "__n")


def filled(grid: DataFrame, ends: dict, sigma: float = 1.0) -> DataFrame:
    """Adds f: z, and in voids the Gaussian of the valid cells around them (0 where none reaches).

    Few voids look their neighbours up by a join; many share window sums over the grid.
    """
    if not ends["voids"]:
        return grid.withColumn("f", F.col("z"))
    w = gaussian(sigma)
    n = len(w) // 2
    if ends["voids"] * len(w) ** 2 > 2 * ends["cells"]:
        return valid_gauss(grid, sigma, "f").withColumn("f", F.coalesce("z", "f"))
    weights, steps = F.array(*map(F.lit, w)), F.sequence(F.lit(-n), F.lit(n))
    near = grid.where("z IS NULL").select("r", "c", F.explode(steps).alias("dr")).select("*", F.explode(steps).alias("dc"))
    near = near.select(
        "r", "c", F.least(F.greatest(F.col("r") + F.col("dr"), F.lit(ends["r0"])), F.lit(ends["r1"])).alias("sr"), F.least(F.greatest(F.col("c") + F.col("dc"), F.lit(ends["c0"])), F.lit(ends["c1"])).alias("sc"),
        (F.element_at(weights, F.col("dr") + n + 1) * F.element_at(weights, F.col("dc") + n + 1)).alias("v"),
    )
    source = grid.where("z IS NOT NULL").select(F.col("r").alias("sr"), F.col("c").alias("sc"), "z")
    means = near.join(source, ["sr", "sc"]).groupBy("r", "c").agg((F.sum(F.col("v") * F.col("z")) / F.sum("v")).alias("f"))
    voids = grid.where("z IS NULL").join(means, ["r", "c"], "left").withColumn("f", F.coalesce("f", F.lit(0.0)))
    return grid.where("z IS NOT NULL").withColumn("f", F.col("z")).unionByName(voids)


def gradient(grid: DataFrame, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Adds p = dz/dx and q = dz/dy for signed steps, and `here`; one shuffle by row and one by column.

    Voids are filled by a Gaussian of their valid neighbours first, so that no cell beside
    them loses its gradient.
    """
    near, f = filled(*complete(grid)), F.col("f")
    return near.withColumn("q", derivative(f, along_column(), pixel[1])).withColumn("p", derivative(f, along_row(), pixel[0])).drop("f")


def box_mean(grid: DataFrame, radius: int, name: str = "mean") -> DataFrame:
    """Mean of valid cells in a square of a complete grid; beyond the raster's edge it is mirrored.

    Cells within reach of an edge are repeated as their mirror images, so that one sum
    over a plain window serves every place. Sums and counts skip voids.
    """
    ends = grid.agg(F.min("r").alias("r0"), F.max("r").alias("r"), F.min("c").alias("c0"), F.max("c").alias("c")).first()
    out = grid.withColumn("__s", F.coalesce("z", F.lit(0.0))).withColumn("__n", F.col("z").isNotNull().cast("double"))
    for key, axis in (("r", "c"), ("c", "r")):
        at, first, last = F.col(axis), ends[axis + "0"] or 0, ends[axis] or 0
        images = F.array(at, F.when(at - first < radius, 2 * first - 1 - at), F.when(at > last - radius, 2 * last + 1 - at))
        out = out.withColumn("__at", F.explode(F.array_compact(images)))
        near = Window.partitionBy(key).orderBy("__at").rowsBetween(-radius, radius)
        out = out.withColumns({x: F.sum(x).over(near) for x in ("__s", "__n")}).where(F.col("__at") == at).drop("__at")
    return out.withColumn(name, F.when(F.col("__n") > 0, F.col("__s") / F.col("__n"))).drop("__s", "__n")
