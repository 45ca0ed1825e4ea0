"""Grids from tables: one row for each pixel (r, c, z), NoData is NULL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def orders_grid(spark: SparkSession, sf_dir: str, holes: int | None = None, block: bool = False) -> DataFrame:
    """The orders table as a nearly square grid, whose last row may end early; every `holes`-th cell, or a block and a border, may be void."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice")
    side = math.ceil(math.sqrt(orders.count()))
    key = F.col("o_orderkey")
    df = orders.select(F.floor(key / side).cast("long").alias("r"), (key % side).cast("long").alias("c"), (F.col("o_totalprice") / 100000.0).alias("z"), key.alias("k"))
    void = F.lit(False)
    if holes:
        void = void | (F.col("k") % holes == 0)
    if block:
        void = void | (F.col("r").between(side // 4, side // 3) & F.col("c").between(side // 4, side // 3)) | (F.col("c") < side // 10)
    return df.select("r", "c", F.when(~void, F.col("z")).alias("z"))


def array_grid(df: DataFrame, row: str, values: str) -> DataFrame:
    """A grid whose rows are arrays."""
    return df.select(F.col(row).cast("long").alias("r"), F.posexplode(values).alias("c", "z")).select("r", F.col("c").cast("long").alias("c"), F.col("z").cast("double").alias("z"))


def void(df: DataFrame, nodata: float | None = None) -> DataFrame:
    """NaN, infinite and NoData (to 1e-6) values as NULL."""
    z = F.col("z").cast("double")
    bad = F.isnan(z) | (F.abs(z) == float("inf"))
    if nodata is not None:
        bad = bad | (F.abs(z - nodata) <= 1e-6)
    return df.withColumn("z", F.when(~bad, z))


#: Cells a side that a folder of tiles holds, or one tile if that is larger.
FOLDER = 512


def window(df: DataFrame, r0: int, r1: int, c0: int, c1: int, tile: int | None = None) -> DataFrame:
    """Pixels of a rectangle; of what write_tiles() wrote only folders that meet it are opened, and in these only pages of tiles that do."""
    inside = F.col("r").between(r0, r1) & F.col("c").between(c0, c1)
    if tile and {"fy", "fx"} <= set(df.columns):
        side = tile * max(1, FOLDER // tile)
        inside = F.col("fy").between(r0 // side, r1 // side) & F.col("fx").between(c0 // side, c1 // side) & inside
    if tile and {"ty", "tx"} <= set(df.columns):
        inside = F.col("ty").between(r0 // tile, r1 // tile) & F.col("tx").between(c0 // tile, c1 // tile) & inside
    return df.where(inside)


def write_tiles(df: DataFrame, path: str, tile: int = 512, overwrite: bool = False) -> None:
    """Parquet sorted by tile, so that windowed reads prune it.

    Tiles share folders of FOLDER cells a side: with a folder for each small tile a large
    raster would be hundreds of thousands of files.
    """
    each = max(1, FOLDER // tile)
    out = df.withColumns({k: F.floor(F.col(x) / tile).cast("int") for k, x in (("ty", "r"), ("tx", "c"))})
    out = out.withColumns({k: F.floor(F.col(x) / each).cast("int") for k, x in (("fy", "ty"), ("fx", "tx"))})
    out.repartition("fy", "fx").sortWithinPartitions("fy", "fx", "ty", "tx").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("fy", "fx").option("compression", "zstd").parquet(path)
