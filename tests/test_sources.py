import json

import numpy as np
import pytest

from reliefspark import __main__ as cli
from reliefspark import api
from reliefspark.operators import kernels as K
from reliefspark.operators import prepare as P
from reliefspark.sources import tiff, zarr
from test_terrain import array_of, grid_of


def hilly(h=21, w=17):
    z = np.random.default_rng(3).random((h, w)) * 100
    z[4:7, 5:8] = np.nan
    z[:2, :3] = np.nan
    return z


@pytest.mark.parametrize(("store", "ending"), [(zarr, "a.zarr"), (tiff, "a.tif")])
def test_stores_give_back_what_they_got(spark, tmp_path, store, ending):
    z, path = hilly(), f"file://{tmp_path}/{ending}"
    store.write(grid_of(spark, z), path, 8)
    back = store.read(spark, path)
    assert back.count() == z.size and np.array_equal(array_of(back, "z", z.shape), z, equal_nan=True)
    with pytest.raises(FileExistsError):
        store.write(grid_of(spark, z), path, 8)
    store.write(grid_of(spark, z[:5]), path, 8, overwrite=True)
    assert store.read(spark, path).count() == z[:5].size


def test_tiles_that_differ_in_nodata_are_refused(spark, tmp_path):
    z = hilly()
    data = tiff.encode(z, 0, 0)
    (tmp_path / "a.tif").write_bytes(data)
    (tmp_path / "b.tif").write_bytes(data.replace(b"nan\0", b"-99\0"))
    with pytest.raises(ValueError):
        tiff.read(spark, f"file://{tmp_path}")


def test_only_the_border_and_dominant_values_go(spark):
    z = np.random.default_rng(4).random((20, 20)) + 1
    z[:, :2] = z[:, -2:] = z[:2] = z[-2:] = -77
    z[9, 9] = np.inf
    out = array_of(P.without_nodata(grid_of(spark, z)), "z", z.shape)
    assert (np.isnan(out) == ((z == -77) | np.isinf(z))).all()
    kept = array_of(P.without_nodata(grid_of(spark, z), "none"), "z", z.shape)
    assert (np.isnan(kept) == np.isinf(z)).all()
    assert np.isnan(array_of(P.without_nodata(grid_of(spark, z), -77), "z", z.shape)).sum() == (z == -77).sum() + 1
    with pytest.raises(ValueError):
        P.nodata_option("other")


def test_prepare_fills_what_its_mode_says(spark):
    z = hilly()
    filled = K.push_pull(z)
    enclosed = array_of(P.prepare(grid_of(spark, z), "enclosed", "none"), "z", z.shape)
    assert np.allclose(enclosed, np.where(K.exterior(z), np.nan, filled), equal_nan=True)
    assert np.allclose(array_of(P.prepare(grid_of(spark, z), "all", "none"), "z", z.shape), filled)
    assert np.array_equal(array_of(P.prepare(grid_of(spark, z), "none", "none"), "z", z.shape), z, equal_nan=True)
    assert P.prepare(grid_of(spark, z).limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.prepare(grid_of(spark, z), "some")


def test_jobs_from_file_to_file(spark, tmp_path, capsys):
    z = hilly()
    zarr.write(grid_of(spark, z), f"file://{tmp_path}/in.zarr", 8)
    note = api.run_pipeline(spark, f"file://{tmp_path}/in.zarr", f"file://{tmp_path}/out.tif", "slope", output_dtype="uint8", mode="local")
    code = array_of(tiff.read(spark, f"file://{tmp_path}/out.tif"), "z", z.shape)
    slope = array_of(api.registry.run(grid_of(spark, z), "slope", mode="local"), "value", z.shape)
    ok = ~np.isnan(slope)
    assert np.isnan(code[~ok]).all() and np.abs(note["scale"] * code[ok] + note["offset"] - slope[ok]).max() <= note["scale"] / 2 + 1e-9
    cli.main(["run", f"file://{tmp_path}/in.zarr", f"file://{tmp_path}/out2.zarr", "--algo", "blur", "--blur-radius", "1", "--no-progress", "--log-level", "ERROR"])
    assert json.loads(capsys.readouterr().out)["dtype"] == "float32"
    assert zarr.read(spark, f"file://{tmp_path}/out2.zarr").count() == z.size
    for bad in ({"algorithm": "none"}, {"output_dtype": "int8"}):
        with pytest.raises(ValueError):
            api.run_pipeline(spark, "x", "y", **bad)


def test_output_ranges():
    assert api.output_range("slope", {"unit": "percent"}) is None
    assert api.output_range("scale_drift", {"drift_output": "direction"}) == (0.0, 1.0)
    assert api.output_range("blur", {}) is None
    with pytest.raises(ValueError):
        api.output_range("slope", {}, (2, 1))


@pytest.mark.parametrize("dtype", ["float32", "int16", "uint8"])
def test_one_file_with_overviews(spark, tmp_path, dtype):
    z = np.random.default_rng(5).random((70, 90)) * 200 + 1
    z = z.astype("f4").astype(float) if dtype == "float32" else np.rint(z)
    z[10:14, 3:9] = np.nan
    path = f"file://{tmp_path}/one.tif"
    tiff.write_cog(grid_of(spark, z), path, dtype, (30.0, -30.0), block=16)
    assert np.array_equal(array_of(tiff.read(spark, path), "z", z.shape), z, equal_nan=True)
    seen = tiff.validate(path)
    assert seen["tiled"] and seen["optimized"] and seen["overviews"] == 3
    data = (tmp_path / "one.tif").read_bytes()
    assert np.array_equal(tiff.decode(data)[0], z, equal_nan=True)
    _, _, second = tiff._fields(data)
    order, f, _ = tiff._fields(data, second)
    at = tiff.Layout(order, f)
    block, y, x = at.block(0, data[at.places[0] : at.places[0] + at.sizes[0]])
    want = tiff._means(z, 2)[: block.shape[0], : block.shape[1]]
    assert np.allclose(block, want if dtype == "float32" else np.rint(want), equal_nan=True, atol=1 if dtype != "float32" else 1e-4)
    assert tiff.metadata(spark, path)["pixel"] == (30.0, -30.0)
    with pytest.raises(FileExistsError):
        tiff.write_cog(grid_of(spark, z), path, dtype)


def test_pixel_size_comes_from_the_file(spark, tmp_path):
    z = (np.random.default_rng(6).random((40, 30)) * 50).astype("f4").astype(float)
    path = f"file://{tmp_path}/geo.tif"
    tiff.write_cog(grid_of(spark, z), path, "float32", (30.0, -30.0))
    api.run_pipeline(spark, path, f"file://{tmp_path}/a.zarr", "slope", mode="local")
    q, p = np.gradient(z, -30.0, 30.0, edge_order=2)
    assert np.allclose(array_of(zarr.read(spark, f"file://{tmp_path}/a.zarr"), "z", z.shape), np.degrees(np.arctan(np.hypot(p, q))), atol=1e-4)
    degrees = f"file://{tmp_path}/deg.tif"
    tiff.write_cog(grid_of(spark, z), degrees, "float32", (0.0003, -0.0003), geographic=True)
    note = tiff.metadata(spark, degrees)
    assert note["geographic"] and abs(note["latitude"]) < 1
    api.run_pipeline(spark, degrees, f"file://{tmp_path}/b.tif", "hillshade", radii=(1, 2))
    assert tiff.validate(f"file://{tmp_path}/b.tif")["tiled"]


def test_interrupted_files_are_resumed(spark, tmp_path, monkeypatch):
    z, path = np.random.default_rng(7).random((30, 30)).astype("f4").astype(float), f"file://{tmp_path}/r.tif"
    with monkeypatch.context() as m:
        m.setattr(tiff, "_header", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            tiff.write_cog(grid_of(spark, z), path)
    monkeypatch.setattr(tiff, "encoded_tiles", lambda *a: 1 / 0)
    tiff.write_cog(grid_of(spark, z), path, resume=True)
    assert np.array_equal(array_of(tiff.read(spark, path), "z", z.shape), z)


def test_lzw():
    # fixed value: the codes 256, 65, 66, 258, 260, 257 in nine bits each
    bits = "".join(f"{c:09b}" for c in (256, 65, 66, 258, 260, 257))
    assert tiff._lzw(int(bits.ljust(56, "0"), 2).to_bytes(7, "big")) == b"ABABABA"


def test_border_zeros_and_sentinels(spark):
    from reliefspark.operators import relational as R

    z = np.random.default_rng(8).random((40, 40)) + 1
    z[:, :20] = 0
    assert [r["z"] for r in R.border_zero(grid_of(spark, z)).collect()] == [0.0]
    assert R.border_zero(grid_of(spark, np.ones((40, 40)))).count() == 0
    for value in (-2147483647.0, -128.0, 127.0, 255.0):
        z[:, :20] = value
        z[0, 30:32] = -3000, 3000
        assert [r["z"] for r in R.sentinel(grid_of(spark, z)).collect()] == [value]
    z[:, :20] = -3.0
    assert R.sentinel(grid_of(spark, z)).count() == 0


def test_rasters_need_not_begin_at_zero(spark):
    z = hilly()
    moved = grid_of(spark, z).selectExpr("r - 100 AS r", "c + 7 AS c", "z")
    out = P.prepare(moved, "all", "none").selectExpr("r + 100 AS r", "c - 7 AS c", "z")
    assert np.allclose(array_of(out, "z", z.shape), K.push_pull(z))
    slope = api.registry.run(moved, "slope", radii=(2,), tile=8).selectExpr("r + 100 AS r", "c - 7 AS c", "value")
    assert np.allclose(array_of(slope, "value", z.shape), array_of(api.registry.run(grid_of(spark, z), "slope", radii=(2,), tile=8), "value", z.shape), equal_nan=True)


def test_options_reach_their_operator():
    args = cli.parser().parse_args(["run", "a", "b", "--algorithm", "lic", "--lic-length", "9", "--lic-field", "contour", "--mode", "local", "--nodata-threshold", "0.5"])
    assert cli.params_of(args) == {"length": 9, "lic_field": "contour", "mode": "local", "skip": 0.5}
    args = cli.parser().parse_args(["run", "a", "b", "--algorithm", "slope", "--lic-length", "9"])
    with pytest.raises(SystemExit):
        cli.params_of(args)
    assert len(cli.own_options()) + len(cli.SPELLED) >= 44
