"""What shows only on grids larger than those of the other tests."""

import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from reliefspark.functions import stencil
from reliefspark.operators import kernels as K
from reliefspark.operators import queries as T
from reliefspark.operators import registry
from reliefspark.plans.tiles import Bounds, on_tiles
from reliefspark.sources import tiff
from reliefspark.sources.grids import window, write_tiles


def waves(spark, h, w):
    """A grid of h x w cells."""
    df = spark.range(h * w).select(F.floor(F.col("id") / w).cast("long").alias("r"), (F.col("id") % w).alias("c"))
    return df.withColumn("z", 20 * F.sin(F.col("r") * 0.7) * F.cos(F.col("c") * 0.3) + F.col("c") * F.col("r") % 7)


def test_tile_files_cover_the_whole_raster(spark, tmp_path):
    grid = waves(spark, 10, 10).where("r < 8 OR c < 3")  # two rows end early, inside a tile and before the next
    tiff.write(grid, f"file://{tmp_path}/a.tif", 4)
    back = tiff.read(spark, f"file://{tmp_path}/a.tif")
    assert back.count() == back.select("r", "c").distinct().count() == 100
    assert {(r["r"], r["c"]): r["z"] for r in back.where("z IS NOT NULL").collect()} == {(r["r"], r["c"]): r["z"] for r in grid.collect()}


def test_range_estimate_takes_the_window_that_its_sql_names(spark):
    grid = waves(spark, 300, 290)
    z = np.zeros((300, 290))
    for r in grid.collect():
        z[r["r"], r["c"]] = r["z"]
    found = {r["window"]: r for r in T._range(grid).collect()}["central"]
    assert np.allclose((found["low"], found["high"]), np.quantile(K.slope(z)[22:278, 17:273], [0.01, 0.99]), atol=1e-9)


def test_void_filling_reads_each_line_once(spark):
    grid = waves(spark, 12, 12).withColumn("z", F.when(F.col("c") > 4, F.col("z")))
    plan = stencil.gradient(grid)._jdf.queryExecution().toString()
    assert "unboundedfollowing" in plan and "currentrow$(), unboundedfollowing$()" not in plan


def test_small_tiles_share_folders(spark, tmp_path):
    grid, path = waves(spark, 40, 40), f"file://{tmp_path}/tiles"
    write_tiles(grid, path, 4)
    assert len(list((tmp_path / "tiles").rglob("*.parquet"))) == 1
    part = window(spark.read.parquet(path), 5, 11, 30, 33, 4).select("r", "c", "z")
    want = grid.where("r BETWEEN 5 AND 11 AND c BETWEEN 30 AND 33")
    assert part.count() == 28 and part.exceptAll(want).isEmpty()


def test_windows_of_a_large_raster_stay_small(spark, monkeypatch):
    seen = []

    def tiles(grid, kernel, halo, tile=512, **more):
        seen.append((halo, tile))
        return grid.withColumnRenamed("z", "value")

    monkeypatch.setattr(registry, "bounds_of", lambda grid: Bounds(0, 7347, 0, 7347))
    monkeypatch.setattr(registry, "on_tiles", tiles)
    grid = waves(spark, 4, 4)
    for name, params in (("hillshade", {"radii": (2, 4), "agg": "stack"}), ("lic", {}), ("fractal_anomaly", {"radii": (2, 4, 6, 8, 12)}), ("scale_drift", {"scales": (2, 4, 8), "drift_output": "direction"})):
        registry.run(grid, name, **params)
    assert len(seen) == 5 and max(tile + 2 * halo for halo, tile in seen) < 800


def test_weighing_makes_no_copy_for_each_weight():
    z, w = np.random.default_rng(3).random((400, 400)), K.taps(5)
    for axis in (0, 1):
        tracemalloc.start()
        found = K.along(z, w, axis)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        p = np.pad(z, [(20, 20), (0, 0)] if axis == 0 else [(0, 0), (20, 20)], mode="edge")
        assert np.array_equal(found, sum(v * np.take(p, np.arange(i, i + 400), axis=axis) for i, v in enumerate(w)))
        assert most < 3.2 * z.nbytes


def test_drift_reaches_as_far_as_its_gaussians(spark):
    halo = registry.OPERATORS["scale_drift"].halo({"scales": [2.0, 4.0, 8.0]})
    z = np.random.default_rng(4).random((150, 150))
    whole = K.scale_drift(z, (2, 4, 8), drift_output="divergence")
    part = K.scale_drift(z[70 - halo : 81 + halo, 60 - halo : 71 + halo], (2, 4, 8), drift_output="divergence")
    assert halo == 50 and np.allclose(part[halo:-halo, halo:-halo], whole[70:81, 60:71], atol=1e-12)


def test_bands_and_repeated_pixels_keep_their_rows(spark):
    z = [(0, 0, 1.0), (0, 0, 1.0), (0, 1, None), (3, 2, 5.0), (-2, -3, 4.0)]
    out = on_tiles(spark.createDataFrame(z, "r long, c long, z double"), lambda x, top, left: np.stack([x, 2 * x]), 1, 2, bands=True)
    rows = sorted((r["r"], r["c"], r["band"], r["value"] or 0.0) for r in out.collect())
    assert rows == sorted((r, c, b, b * (v or 0.0)) for r, c, v in z for b in (1, 2))
    assert "Generate posexplode" not in out._jdf.queryExecution().toString()
