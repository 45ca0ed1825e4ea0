import numpy as np
import pytest
from test_terrain import array_of, grid_of

from reliefspark import api
from reliefspark.functions import scales


def test_signed_steps_follow_the_latitude():
    x, y = scales.metric_pixel(1, -1, 35)
    assert abs(x - 91288.0) < 15 and abs(y + 110940.5) < 15
    assert scales.metric_pixel(30, -30) == (30, -30)
    with pytest.raises(ValueError):
        scales.metric_pixel(0, 1)


def test_job_with_pixel_sizes_and_bands(spark, tmp_path):
    z = np.random.default_rng(4).random((20, 24)) * 100
    src = str(tmp_path / "raw.zarr")
    api.save(grid_of(spark, z), src, tile=16)
    q, p = np.gradient(z.astype("f4").astype(float), -20.0, 10.0, edge_order=2)
    api.run_pipeline(spark, src, str(tmp_path / "slope.zarr"), "slope", mode="local", pixel_size=(10.0, -20.0), tile=16)
    out = array_of(api.load(spark, str(tmp_path / "slope.zarr")), "z", z.shape)
    assert np.allclose(out, np.degrees(np.arctan(np.hypot(p, q))), atol=1e-4)
    note = api.run_pipeline(spark, src, str(tmp_path / "s.zarr"), "slope", radii=(1, 2), agg="stack", pixel_size=10.0, tile=16)
    assert (note["dtype"], note["bands"]) == ("float32", 2)
    q, p = np.gradient(z.astype("f4").astype(float), 10.0, edge_order=2)
    first = array_of(api.load(spark, str(tmp_path / "s.band1.zarr")), "z", z.shape)
    assert np.allclose(first, np.degrees(np.arctan(np.hypot(p, q))), atol=1e-4)
    assert not np.allclose(first, array_of(api.load(spark, str(tmp_path / "s.band2.zarr")), "z", z.shape))


def test_settings_that_do_not_fit_are_refused(spark, tmp_path):
    src = str(tmp_path / "raw.zarr")
    api.save(grid_of(spark, np.ones((8, 8))), src)
    for more in ({"algorithm": "blur", "agg": "stack"}, {"algorithm": "blur", "pixel_size": 2.0}, {"algorithm": "slope", "latitude": 35.0}):
        with pytest.raises(ValueError):
            api.run_pipeline(spark, src, str(tmp_path / "no.zarr"), **more)
