import numpy as np
import pytest
from test_terrain import array_of, grid_of

from reliefspark.operators import registry
from reliefspark.plans.tiles import Bounds
from reliefspark.streaming import ingest


def test_results_follow_arriving_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    z = rng.random((30, 26)) * 9
    bounds, paths = Bounds(0, 29, 0, 25), {k: f"file://{tmp_path}/{k}" for k in ("source", "store", "out", "checkpoint")}
    df = grid_of(spark, z)

    def add(rows):
        rows.coalesce(1).write.mode("append").parquet(paths["source"])
        ingest.follow(spark, paths["source"], paths["store"], paths["out"], paths["checkpoint"], "slope", bounds, tile=8, radii=(1, 2)).awaitTermination(300)
        return spark.read.parquet(paths["out"])

    add(df.where("r < 17"))
    seen = add(df.where("r >= 17"))
    want = array_of(registry.run(df, "slope", radii=(1, 2), tile=64), "value", z.shape)
    assert seen.count() == z.size and np.allclose(array_of(seen, "value", z.shape), want)
    z[3, 4] = 50.0
    seen = add(spark.createDataFrame([(3, 4, 50.0)], "r long, c long, z double"))
    want = array_of(registry.run(grid_of(spark, z), "slope", radii=(1, 2), tile=64), "value", z.shape)
    assert seen.count() == z.size and np.allclose(array_of(seen, "value", z.shape), want)
    with pytest.raises(ValueError):
        registry.tile_function("openness", bounds)
