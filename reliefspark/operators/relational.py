"""Operators that are expressions, windows and aggregates over pixel rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scales
from ..functions.quantiles import quantiles
from ..functions.stencil import along_column, along_row, box_mean, complete, derivative, gradient, valid_gauss
from ..sources.shared import kept


def _clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Bounded, and NULL where x is (least and greatest alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def _out(df: DataFrame, value: Column, name: str) -> DataFrame:
    return df.where("here").select("r", "c", F.when(F.col("z").isNotNull(), value).alias(name))


def _pq() -> tuple[Column, Column]:
    return F.col("p"), F.col("q")


def lambert(azimuth: float, altitude: float) -> Column:
    p, q = _pq()
    a, h = math.radians(azimuth), math.radians(altitude)
    light = (math.sin(a) * math.cos(h), math.cos(a) * math.cos(h), math.sin(h))
    return (-p * light[0] - q * light[1] + light[2]) / F.sqrt(p * p + q * q + 1)


def slope(grid: DataFrame, unit: str = "degree", pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    p, q = _pq()
    steep = F.sqrt(p * p + q * q)
    value = {"degree": F.degrees(F.atan(steep)), "percent": F.tan(F.atan(steep)) * 100}.get(unit, F.atan(steep))
    return _out(gradient(grid, pixel), value, "slope")


def hillshade(grid: DataFrame, azimuth: float = 315, altitude: float = 45, z_factor: float = 1, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    return _out(gradient(grid.withColumn("z", F.col("z") * z_factor), pixel), _clip(lambert(azimuth, altitude)), "shade")


def atmospheric_scattering(grid: DataFrame, scattering_strength: float = 0.5, intensity: float | None = None, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    p, q = _pq()
    mass = 1 / (F.cos(F.atan(F.sqrt(p * p + q * q))) + 0.001)
    haze = 1 - F.exp(-(scattering_strength if intensity is None else intensity) * mass)
    return _out(gradient(grid, pixel), F.pow(_clip(0.3 * (0.4 + 0.6 * haze) + 0.7 * _clip(lambert(315, 45))), F.lit(scales.GAMMA)), "scatter")


def multi_light_uncertainty(grid: DataFrame, azimuths: tuple[float, ...] = (315, 45, 135, 225), altitude: float = 45, z_factor: float = 1, uncertainty_weight: float = 0.7, pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    if not azimuths:
        raise ValueError("no azimuths")
    lights = [F.greatest(F.lit(0.0), lambert(a, altitude)) for a in azimuths]
    df = gradient(grid.withColumn("z", F.col("z") * z_factor), pixel).withColumns({f"l{i}": x for i, x in enumerate(lights)})
    n = len(lights)
    mean = sum((F.col(f"l{i}") for i in range(1, n)), F.col("l0")) / n
    df = df.withColumn("m", mean)
    spread = F.sqrt(sum(((F.col(f"l{i}") - F.col("m")) * (F.col(f"l{i}") - F.col("m")) for i in range(1, n)), (F.col("l0") - F.col("m")) * (F.col("l0") - F.col("m"))) / n)
    return _out(df, _clip(F.col("m") + uncertainty_weight * _clip(spread / (F.col("m") + 1e-6))), "uncertainty")


def curvature(grid: DataFrame, curvature_type: str = "mean", pixel: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The signs of the steps do not matter: turning an axis round leaves every kind as it is."""
    (dx, dy), (p, q) = map(abs, pixel), _pq()
    df = gradient(grid, (dx, dy))
    df = df.withColumn("r_", derivative(p, along_row(), dx)).withColumn("qx", derivative(q, along_row(), dx)).withColumn("py", derivative(p, along_column(), dy)).withColumn("t_", derivative(q, along_column(), dy))
    r, t, py, s = F.col("r_"), F.col("t_"), F.col("py"), (F.col("py") + F.col("qx")) / 2
    g = p * p + q * q
    k = {
        "mean": -((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * F.pow(1 + g, F.lit(1.5)) + 1e-10),
        "gaussian": (r * t - py * py) / ((1 + g) * (1 + g)),
        "planform": -(q * q * r - 2 * p * q * py + p * p * t) / (F.pow(g, F.lit(1.5)) + 1e-10),
    }.get(curvature_type, -(p * p * r + 2 * p * q * py + q * q * t) / (g * F.pow(1 + g, F.lit(1.5)) + 1e-10))
    return _out(df, F.pow((F.tanh(100 * k) + 1) / 2, F.lit(scales.GAMMA)), "curvature")


def topousm(grid: DataFrame, radii: list[int], weights: list[float] | None = None) -> DataFrame:
    """Weighted height above box means, divided by the 99th percentile of its size."""
    if weights is not None and len(weights) != len(radii):
        raise ValueError("as many weights as radii")
    weights = weights or scales.auto_weights(len(radii))
    df, _ = complete(grid)
    for i, r in enumerate(radii):
        df = valid_gauss(df, 1.0, f"m{i}") if r <= 1 else box_mean(df, r, f"m{i}")
    raw = sum((w * (F.col("z") - F.col(f"m{i}")) for i, w in enumerate(weights)), F.lit(0.0))
    df = kept(_out(df, raw, "x"), "topousm")
    scale = quantiles(df, F.abs("x"), [0.99])[0] or df.agg(F.stddev_pop("x")).first()[0] or 1.0
    return df.select("r", "c", (F.col("x") / scale).alias("detail"))


def quantize(df: DataFrame, value: str, kind: str, low: float, high: float) -> DataFrame:
    a, b, least, most = scales.quantizer(kind, low, high)
    code = F.least(F.greatest(F.rint(F.col(value) * a + b), F.lit(float(least))), F.lit(float(most)))
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf"))
    return df.select("r", "c", F.when(bad, F.lit(0)).otherwise(code).cast("short").alias("code"))


def coarsen(grid: DataFrame, factor: int) -> DataFrame:
    """Mean of the valid cells of each block, and how many there are."""
    block = [F.floor(F.col(x) / factor).cast("long").alias(x) for x in ("r", "c")]
    return grid.groupBy(*block).agg(F.avg("z").alias("z"), F.count("z").alias("n"))


def pyramid(grid: DataFrame, levels: list[int]) -> DataFrame:
    """Overviews: each level is made from the one before it (levels double)."""
    out = None
    at = grid.select("r", "c", F.coalesce("z", F.lit(0.0)).alias("s"), F.col("z").isNotNull().cast("long").alias("n"))
    before = 1
    for level in levels:
        step = level // before
        at = at.groupBy(F.floor(F.col("r") / step).cast("long").alias("r"), F.floor(F.col("c") / step).cast("long").alias("c")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        one = at.select(F.lit(level).alias("level"), "r", "c", F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("z"))
        out, before = one if out is None else out.unionByName(one), level
    return out


def valid_box(grid: DataFrame) -> DataFrame:
    return grid.where(F.col("z").isNotNull()).agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("n"))


def central(grid: DataFrame, bounds, halo: int = 0, most: int = 4096) -> DataFrame:
    """The pixels of a window in the middle: `most` cells or four halos a side, if the raster has so many."""
    h, w = bounds.shape
    side = max(256, min(h, w, max(most, 4 * halo)))
    r, c = bounds.r0 + max(0, (h - side) // 2), bounds.c0 + max(0, (w - side) // 2)
    return grid.where(F.col("r").between(r, r + side - 1) & F.col("c").between(c, c + side - 1))


def range_estimate(grid: DataFrame, value: str, bounds, most: int = 4096) -> tuple[float, float] | None:
    """1st and 99th percentile of the window in the middle, as a range for integer codes."""
    low, high = quantiles(central(grid, bounds, most=most), F.col(value), [0.01, 0.99])
    return None if low is None or high <= low else (low, high)


def stratified(grid: DataFrame, bounds, side: int = 2048, each: int = 3) -> DataFrame:
    """The pixels of each x each windows spread over the raster; a small raster is one window."""

    def starts(first: int, n: int) -> list[int]:
        return sorted({first + round(i * max(0, n - side) / (each - 1)) for i in range(each)})

    inside = F.lit(False)
    for r in starts(bounds.r0, bounds.shape[0]):
        for c in starts(bounds.c0, bounds.shape[1]):
            inside = inside | (F.col("r").between(r, r + side - 1) & F.col("c").between(c, c + side - 1))
    return grid.where(inside)


def tile_voids(grid: DataFrame, tile: int) -> DataFrame:
    return grid.groupBy(F.floor(F.col("r") / tile).cast("long").alias("ty"), F.floor(F.col("c") / tile).cast("long").alias("tx")).agg(F.avg(F.col("z").isNull().cast("double")).alias("share"), F.count("*").alias("n"))


def dominant_value(grid: DataFrame) -> DataFrame:
    """The most frequent value (ties to the least) with its count, and the grid's range."""
    best = grid.where(F.col("z").isNotNull()).groupBy("z").count().orderBy(F.desc("count"), "z").limit(1)
    span = grid.agg(F.count("z").alias("valid"), F.min("z").alias("low"), F.max("z").alias("high"))
    return best.crossJoin(F.broadcast(span))  # one row each


# Customary NoData values.
SENTINELS = (
    0.0, -9999.0, -99999.0, 9999.0,
    -32768.0, 32767.0, -32767.0, 65535.0,
    -2147483648.0, 2147483647.0, -2147483647.0,
    -128.0, 127.0, 255.0,
)


def sentinel(grid: DataFrame, share: float = 0.05, least: int = 64) -> DataFrame:
    """The dominant value where it looks like undeclared NoData; no row otherwise."""
    z = F.col("z")
    known = F.lit(False)
    for s in SENTINELS:
        known = known | (F.abs(z - s) <= 1e-6 * max(1.0, abs(s)))
    looks = known | (F.abs(z) >= 1e30) | (z == F.col("low")) | (z == F.col("high"))
    return dominant_value(grid).where((F.col("valid") >= least) & (F.col("count") >= share * F.col("valid")) & looks).select("z", "count", "valid")


def implicit_nodata(grid: DataFrame, share: float = 0.01) -> DataFrame:
    """Customary NoData values that at least a share of the cells hold, for a warning."""
    # fixed values: those that are looked for
    values = (0.0, -9999.0, 9999.0, -32768.0, 32768.0)
    sums = [F.avg(F.coalesce((F.abs(F.col("z") - v) <= 1e-6).cast("double"), F.lit(0.0))).alias(f"s{i}") for i, v in enumerate(values)]
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("z"), F.col(f"s{i}").alias("share")) for i, v in enumerate(values)]))
    return grid.agg(*sums).select(pairs.alias("x")).select("x.*").where(F.col("share") >= share)


def _border(grid: DataFrame, width: int = 1) -> DataFrame:
    ends = grid.agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    near = [F.col("r") < F.col("r0") + width, F.col("c") < F.col("c0") + width, F.col("r") > F.col("r1") - width, F.col("c") > F.col("c1") - width]
    return grid.crossJoin(F.broadcast(ends)).where(near[0] | near[1] | near[2] | near[3])  # one row of ends


def border_zero(grid: DataFrame) -> DataFrame:
    """0 where zeros so rule the border that they must be NoData; no row otherwise.

    The border is a twentieth of each side wide, 64 cells at most. Six tenths of zeros
    decide, or three tenths beside other values.
    """
    h, w = grid.agg(F.max("r") - F.min("r") + 1, F.max("c") - F.min("c") + 1).first()
    ring = _border(grid, min(64, max(1, (h or 0) // 20), max(1, (w or 0) // 20))).where("z IS NOT NULL")
    share = ring.agg(F.avg((F.col("z") == 0).cast("double")).alias("share"), F.count("*").alias("n"))
    return share.where((F.col("share") >= 0.6) | ((F.col("share") >= 0.3) & (F.col("share") < 1))).select(F.lit(0.0).alias("z"), "share", "n")


def border_zero_share(grid: DataFrame) -> DataFrame:
    ring = _border(grid)
    return ring.agg(F.avg((F.col("z") == 0).cast("double")).alias("zero_share"), F.count("*").alias("n"))
