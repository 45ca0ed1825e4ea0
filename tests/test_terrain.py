import numpy as np
import pytest
from oracle import differences
from pyspark.sql import functions as F

from reliefspark.functions import scales
from reliefspark.operators import kernels as K
from reliefspark.operators import queries as T
from reliefspark.operators import registry
from reliefspark.operators import relational as R
from reliefspark.plans.tiles import Bounds, on_tiles

SF = "/root/testdata/sf0.001"


def grid_of(spark, z):
    return spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(z)], "r long, c long, z double")


def array_of(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["r"], r["c"]] = np.nan if r[name] is None else r[name]
    return out


@pytest.mark.parametrize("name", sorted(T.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert not differences(spark, name, T.queries()[name], T.oracle_sql()[name], SF)


def test_slope_equals_numpy(spark):
    z = np.random.default_rng(0).random((12, 15))
    q, p = np.gradient(z, edge_order=2)
    assert np.allclose(array_of(R.slope(grid_of(spark, z)), "slope", z.shape), np.degrees(np.arctan(np.hypot(p, q))))


def test_tiles_do_not_show(spark):
    z = np.random.default_rng(1).random((40, 37))
    z[9:12, 20:24] = z[30, 30] = z[:2, :9] = np.nan
    df = grid_of(spark, z)
    for name, params in (("structure_tensor", {"radii": (2,)}), ("lic", {"length": 5}), ("tv_decomposition", {"iterations": 12, "component": "structure"}), ("specular", {"roughness_scale": 5, "mode": "local"}), ("npr_edges", {"radii": (1, 3)}), ("hillshade", {"radii": (1, 4)}), ("fractal_anomaly", {"radii": (1, 2, 3, 4, 5)}), ("openness", {"max_distance": 5, "mode": "local"}), ("frangi", {"radii": (2,)})):
        a = array_of(registry.run(df, name, tile=16, **params), "value", z.shape)
        b = array_of(registry.run(df, name, tile=64, **params), "value", z.shape)
        assert np.allclose(a, b, atol=1e-9, equal_nan=True), name


def test_voids_stay_void(spark):
    z = np.random.default_rng(2).random((20, 20))
    z[5:8, 5:8] = np.nan
    out = array_of(on_tiles(grid_of(spark, z), lambda x, top, left: K.blur(x, 2), 9, 16), "value", z.shape)
    assert (np.isnan(out) == np.isnan(z)).all()


def test_fill_keeps_valid_cells_and_stays_in_range():
    z = np.arange(64.0).reshape(8, 8)
    hole = z.copy()
    hole[3:5, 3:5] = np.nan
    out = K.push_pull(hole)
    assert np.isfinite(out).all() and out.min() >= 0 and out.max() <= 63
    assert (out[~np.isnan(hole)] == z[~np.isnan(hole)]).all()
    assert (K.push_pull(np.full((4, 4), np.nan)) == 0).all()


def test_exterior_is_what_the_border_reaches():
    z = np.zeros((9, 9))
    z[3:5, 3:5] = np.nan
    z[0:2, 7] = np.nan
    out = K.exterior(z)
    assert out.sum() == 2 and not out[3, 3]


def test_structure_follows_stripes():
    y, x = np.mgrid[:64, :64]
    a = K.structure_tensor(10 * np.sin(2 * np.pi * x / 16), radii=(8,))
    b = K.structure_tensor(np.random.default_rng(3).normal(size=(64, 64)), radii=(8,))
    assert a[16:48, 16:48].mean() > 0.9 > b[16:48, 16:48].mean()


def test_frangi_tells_ridges_from_valleys():
    y, _ = np.mgrid[:64, :64]
    z = 20 * np.exp(-((y - 32.0) ** 2) / 32)
    assert K.frangi(z, feature_type="ridge", stat=(5.0,))[32, 32] > 10 * K.frangi(z, feature_type="valley", stat=(5.0,))[32, 32]


def test_scales():
    assert scales.auto_radii(30000) == [2, 8, 32, 128, 512, 2048]
    assert scales.auto_radii(15) == [2]
    assert scales.clean_radii([4, "x", -1, 4.2, 9], 100) == [4, 9]
    assert abs(sum(scales.auto_weights(4)) - 1) < 1e-12
    lat, lon = scales.metres_per_degree(35)
    assert abs(lat - 110940.5) < 15 and abs(lon - 91288.0) < 15
    with pytest.raises(ValueError):
        scales.quantizer("uint8", 1, 1)


def test_empty_grid(spark):
    df = spark.createDataFrame([], "r long, c long, z double")
    assert R.slope(df).count() == 0
    assert R.coarsen(df, 4).count() == 0


def test_pixels_without_a_row_count_as_voids(spark):
    z = np.random.default_rng(5).random((14, 11))
    hole = z.copy()
    hole[4, 5] = hole[13, 2:] = np.nan
    sparse = grid_of(spark, hole).where("z IS NOT NULL")
    for name, params in (("slope", {"mode": "local"}), ("curvature", {"mode": "local"}), ("slope", {"radii": (2, 4)}), ("ambient_occlusion", {"mode": "local", "radius": 3})):
        a = array_of(registry.run(grid_of(spark, hole), name, **params), "value", z.shape)
        rows = registry.run(sparse, name, **params)
        assert rows.count() == np.isfinite(hole).sum() and np.allclose(a, array_of(rows, "value", z.shape), equal_nan=True), name
        assert (np.isnan(a) == np.isnan(hole)).all()


def test_local_expressions_equal_kernels(spark):
    z = np.random.default_rng(6).random((15, 13)) * 5
    z[3:5, 6] = np.nan
    for name in registry.RELATIONAL:
        a = array_of(registry.run(grid_of(spark, z), name, mode="local", pixel=(2.0, -3.0)), "value", z.shape)
        b = np.where(np.isnan(z), np.nan, registry.OPERATORS[name].kernel(z, pixel=(2.0, -3.0)))
        assert np.allclose(a, b, equal_nan=True), name


def test_radii_and_weights_by_default():
    b = Bounds(0, 299, 0, 399)
    assert registry.resolved("slope", b, {})[:2] == ([2, 8], [2 / 3, 1 / 3])
    assert registry.resolved("slope", b, {"mode": "local"})[:2] == ([1], [1.0])
    assert registry.resolved("hillshade", b, {"radii": (4, 4, 9), "weights": (1, 1, 2)})[:2] == ([4, 9], scales.auto_weights(2))
    assert registry.resolved("frangi", b, {})[2]["radii"] == [2, 8]
    assert registry.resolved("topousm_fast", b, {"radii": (3, 5)})[2]["weights"] == [2 / 3, 1 / 3]
    assert registry.resolved("fractal_anomaly", b, {"pixel": (1.0, 1.0)})[2]["radii"] == [4, 8, 16, 24, 32, 48]
    assert registry.resolved("blur", b, {"mode": "local"})[2]["radii"] == [1]
    with pytest.warns(UserWarning):
        assert registry.resolved("scale_drift", b, {"mode": "local"})[2]["scales"] == [2, 4, 8, 16, 32]
    with pytest.raises(ValueError):
        registry.resolved("topousm_fast", b, {"radii": (3, 5), "weights": (1,)})
    assert scales.merged([2, 3, 2], [1, 2, 1]) == ([2, 3], [0.5, 0.5])


def test_unknown_parameters_are_refused(spark):
    df = grid_of(spark, np.ones((4, 4)))
    for name, params in (("slope", {"azimut": 3}), ("lic", {"weights_": 1}), ("no", {}), ("slope", {"unit": "grad"}), ("slope", {"mode": "both"})):
        with pytest.raises(ValueError):
            registry.run(df, name, **params)


@pytest.mark.parametrize("few", [20_000, 50])
def test_quantiles_are_exact(spark, monkeypatch, few):
    from reliefspark.functions import quantiles as Q

    monkeypatch.setattr(Q, "FEW", few)
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=3000), np.full(500, 0.25), [1e9, -1e12], rng.integers(0, 5, 200)])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)] * 5, "x double")
    shares = [0.0, 0.01, 0.5, 0.513, 0.98, 1.0]
    assert np.allclose(Q.quantiles(df, F.col("x"), shares), np.percentile(x, [100 * q for q in shares]), rtol=1e-12, atol=1e-12)
    assert Q.quantiles(df.where("x IS NULL"), F.col("x"), [0.5]) == [None]


def test_large_radii_come_from_an_overview(spark, monkeypatch):
    monkeypatch.setattr(registry, "LARGE", 8)
    y, x = np.mgrid[:96, :96]
    z = 40 * np.sin(x / 13) + 60 * np.cos(y / 19)
    df = grid_of(spark, z)
    for name, params in (("slope", {"radii": (2, 16)}), ("topousm_fast", {"radii": (2, 16)}), ("ambient_occlusion", {"radii": (2, 16)}), ("multiscale_terrain", {"scales": (1, 12)}), ("npr_edges", {"radii": (2, 16)}), ("specular", {"radii": (2, 12)})):
        near = array_of(registry.run(df, name, tile=40, overview=4096, **params), "value", z.shape)
        far = array_of(registry.run(df, name, tile=40, overview=48, **params), "value", z.shape)
        again = array_of(registry.run(df, name, tile=96, overview=48, **params), "value", z.shape)
        assert np.allclose(far, again, atol=1e-9), name
        assert np.nanmedian(np.abs(near - far)) < 0.1 * (near.max() - near.min()), name


def test_approximate_smoothing_stays_near(spark):
    y, x = np.mgrid[:90, :90]
    df = grid_of(spark, 40 * np.sin(x / 13) + 60 * np.cos(y / 19))
    a, b = (array_of(registry.run(df, "slope", tile=512, radii=(60,), approx=p), "value", (90, 90)) for p in (False, True))
    assert 0 < np.abs(a - b)[4:-4, 4:-4].max() < 2  # edges are flatter


def test_tiles_of_voids_are_skipped(spark):
    z = np.random.default_rng(8).random((32, 32))
    z[:16, :15] = np.nan
    df = grid_of(spark, z)
    a = array_of(registry.run(df, "blur", tile=16, radius=2, skip=0.9), "value", z.shape)
    b = array_of(registry.run(df, "blur", tile=16, radius=2), "value", z.shape)
    assert np.isnan(a[:16, :16]).all() and np.allclose(a[16:], b[16:]) and np.allclose(a[:, 16:], b[:, 16:]) and np.isfinite(b[0, 15])


def test_raw_responses_are_computed_once(spark):
    plan = registry.run(grid_of(spark, np.random.default_rng(9).random((20, 20))), "openness", mode="local", max_distance=4)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Exchange" not in plan


def test_resolution_rules():
    assert [scales.resolution_class(x) for x in (0.5, 1, 2, 5, 10, 30, 90)] == ["ultra_high", "very_high", "high", "medium", "low", "very_low", "ultra_low"]
    assert [scales.shrink_factor(r, "slope") for r in (10, 30, 50, 100, 5000)] == [1, 1, 2, 4, 16]
    assert scales.shrink_factor(42, "topousm_fast") == 2 and scales.overview_factor(2048) == 1 and scales.overview_factor(20000) == 16
    with pytest.raises(ValueError):
        registry.register("slope", K.blur, lambda p: 1)


def test_tiles_follow_halo_memory_and_cores():
    assert scales.auto_tile(6, 40_000, 1000) >= 640 and scales.auto_tile(6, 400, 8) == 128
    assert scales.auto_tile(60, 400, 8) == 128 and scales.auto_tile(6, 1_000_000, 8) == 1504
    with pytest.warns(UserWarning):
        scales.auto_tile(700, 40_000, 100)


def test_statistics_of_windows(spark):
    z = np.random.default_rng(10).random((60, 60))
    a, b = (array_of(registry.run(grid_of(spark, z), "openness", mode="local", max_distance=3, **p), "value", z.shape) for p in ({}, {"sample": "stratified"}))
    assert np.allclose(a, b)  # one window holds a small raster
    assert R.stratified(grid_of(spark, z), Bounds(0, 59, 0, 59), side=10).count() == 900
    assert R.central(grid_of(spark, z), Bounds(0, 59, 0, 59)).count() == 3600
