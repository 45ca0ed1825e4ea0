"""Tiles with halo: every task gets one tile's window and gives its core back."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch that a tile gives back.
BATCH = 50_000


class Bounds(NamedTuple):
    """First and last row and column of a raster."""

    r0: int
    r1: int
    c0: int
    c1: int

    @property
    def shape(self) -> tuple[int, int]:
        return self.r1 - self.r0 + 1, self.c1 - self.c0 + 1


def bounds_of(grid: DataFrame) -> Bounds | None:
    """A raster's bounds, None without pixels."""
    ends = grid.agg(F.min("r"), F.max("r"), F.min("c"), F.max("c")).first()
    return None if ends[0] is None else Bounds(*(int(x) for x in ends))


def on_tiles(
    grid: DataFrame, kernel: Callable[[np.ndarray, int, int], np.ndarray], halo: int, tile: int = 512, name: str = "value",
    bounds: Bounds | None = None, bands: bool = False, skip: float | None = None,
) -> DataFrame:
    """Apply kernel(array, first row, first column) tile by tile; voids stay void.

    A pixel goes to each tile whose window (core plus halo, clipped at the raster's edge)
    holds it: to one tile for most pixels if the halo is small against the tile. Pixels
    that have no row count as voids and get none. With `bands` the kernel gives one array
    a band and the result has a column band, from 1. Tiles whose core is void to the share
    `skip` or more give NULL without running the kernel.
    """
    bounds = bounds or bounds_of(grid)
    if bounds is None:
        kind = "r long, c long, " + ("band int, " if bands else "") + f"{name} double"
        return grid.sparkSession.createDataFrame([], kind)
    r_first, r_last, c_first, c_last = bounds

    def tiles(at: str, first: int, last: int):
        low = F.greatest(F.floor((F.col(at) - halo) / tile), F.floor(F.lit(first) / tile))
        high = F.least(F.floor((F.col(at) + halo) / tile), F.floor(F.lit(last) / tile))
        return F.explode(F.sequence(low.cast("long"), high.cast("long")))

    top = F.greatest(F.lit(r_first), F.col("ty") * tile - halo)
    left, right = F.greatest(F.lit(c_first), F.col("tx") * tile - halo), F.least(F.lit(c_last), (F.col("tx") + 1) * tile + halo - 1)
    # a cell's place in its window is all that travels beside its value; cells beyond given bounds have none, which is an error
    inside = F.col("r").between(r_first, r_last) & F.col("c").between(c_first, c_last)
    place = F.when(inside, (F.col("r") - top) * (right - left + 1) + F.col("c") - left).cast("int").alias("place")
    dealt = grid.select("r", "c", F.col("z").cast("double").alias("z"), tiles("r", r_first, r_last).alias("ty")).select("*", tiles("c", c_first, c_last).alias("tx")).select("ty", "tx", place, "z")
    kind = {"r": pa.int64(), "c": pa.int64()} | ({"band": pa.int32()} if bands else {}) | {name: pa.float64()}

    def work(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ty, tx = (k.as_py() for k in key)
        top, left = max(r_first, ty * tile - halo), max(c_first, tx * tile - halo)
        z = np.full((min(r_last, (ty + 1) * tile + halo - 1) - top + 1, min(c_last, (tx + 1) * tile + halo - 1) - left + 1), np.nan)
        own, voids = [np.zeros(0, np.int32)], [np.zeros(0, bool)]
        for b in batches:  # the window is filled batch by batch, so that its rows are never held beside it
            at, v = b.column("place").to_numpy(), b.column("z").to_numpy(zero_copy_only=False)
            z.ravel()[at] = v
            core = ((at // z.shape[1] + top) // tile == ty) & ((at % z.shape[1] + left) // tile == tx)
            own.append(at[core])
            voids.append(np.isnan(v[core]))
        at, void = np.concatenate(own), np.concatenate(voids)
        del own, voids
        if not len(at) or (skip is not None and void.mean() >= skip):
            value = np.full((0 if bands else 1, *z.shape), np.nan)
        else:
            value = np.asarray(kernel(z, top, left), float)
            value = value if bands else value[None]
        del z
        for band, field in enumerate(value, 1):
            for i in range(0, len(at), BATCH):
                r, c = np.divmod(at[i : i + BATCH].astype(np.int64), field.shape[1])
                out = np.where(void[i : i + BATCH], np.nan, field[r, c])
                more = {"band": pa.array(np.full(len(r), band, np.int32))} if bands else {}
                yield pa.RecordBatch.from_pydict({"r": pa.array(r + top), "c": pa.array(c + left), **more, name: pa.array(out, from_pandas=True)}, pa.schema(kind))

    return dealt.groupBy("ty", "tx").applyInArrow(work, "r long, c long, " + ("band int, " if bands else "") + f"{name} double")
