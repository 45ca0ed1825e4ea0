"""The 21 analysis operators by name: scales first, then statistics, tiles and normalization.

Modes: `spatial` (the default) answers at several radii and blends them, `local` at one
cell's neighbourhood. Radii that are not given follow the raster's size, weights that are
not given halve from scale to scale. Single-scale gradients are window expressions; all
else are array kernels on tiles with halo. Raw responses that need statistics of the whole
grid are written once to the shared folder, so kernels run once. Radii above LARGE are
answered on an overview of at most OVERVIEW cells a side and sampled back, so that halos
stay small; overviews also bound what is gathered.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scales as S
from ..functions.quantiles import quantiles
from ..functions.scales import GAMMA
from ..plans.tiles import Bounds, bounds_of, on_tiles
from ..sources.shared import kept
from . import kernels as K
from . import relational as R

#: Radii above it are answered on an overview of at most so many cells a side.
LARGE, OVERVIEW = 256, 2048


def _x() -> Column:
    return F.col("value")


def _or(value: float | None, other: float) -> float:
    return value if value else other


def _stretch(low: float, high: float) -> Callable:
    """(x - p_low) / (p_high - p_low) from 0 up; unchanged where the two coincide."""

    def apply(df: DataFrame, params: dict) -> DataFrame:
        a, b = quantiles(df, _x(), [low, high])
        if a is None or b - a <= 1e-12:
            return df
        return df.withColumn("value", F.when(_x().isNotNull(), F.greatest((_x() - a) / (b - a), F.lit(0.0))))

    return apply


def _above(low: float | None, power: float = 1.0) -> Callable:
    """max(x - p_low, 0) over its 99th percentile, raised to a power."""

    def apply(df: DataFrame, params: dict) -> DataFrame:
        base = quantiles(df, _x(), [low])[0] or 0.0 if low is not None else 0.0
        over = F.when(_x().isNotNull(), F.greatest(_x() - base, F.lit(0.0)))
        top = quantiles(df, over, [0.99])[0]
        return df.withColumn("value", F.pow(over / (top if top and top > 1e-9 else 1.0), F.lit(power)))

    return apply


def _detail(df: DataFrame, params: dict) -> DataFrame:
    top = quantiles(df, F.abs(_x()), [0.99])[0]
    return df.withColumn("value", _x() / _or(top, _or(df.agg(F.stddev_pop(_x())).first()[0], 1.0)))


def _surprise(df: DataFrame, params: dict) -> DataFrame:
    if not params["normalize"]:
        return df
    a, b = quantiles(df, F.when(_x().isNotNull(), F.greatest(_x(), F.lit(0.0))), [0.02, 0.99])
    return df if a is None or b <= a else df.withColumn("value", F.when(_x().isNotNull(), F.pow(F.greatest((_x() - a) / (b - a), F.lit(0.0)), F.lit(1 / max(params["enhancement"], 1e-6)))))


def _texture(df: DataFrame, params: dict) -> DataFrame:
    if params["component"] == "structure":
        return df
    return df.withColumn("value", 0.5 + 0.5 * F.tanh(_x() / _or(quantiles(df, F.abs(_x()), [0.9])[0], 1.0)))


def _tensor(df: DataFrame, params: dict) -> DataFrame:
    return df if params["st_output"] == "orientation" else _stretch(0.02, 0.98)(df, params)


def _drift(df: DataFrame, params: dict) -> DataFrame:
    if params["drift_output"] == "direction":
        return df
    if params["drift_output"] == "magnitude":
        return _stretch(0.02, 0.98)(df, params)
    return df.withColumn("value", 0.5 + 0.5 * F.tanh(_x() / _or(quantiles(df, F.abs(_x()), [0.95])[0], 1.0)))


def _relief(df: DataFrame, params: dict) -> tuple[float, ...]:
    a, b = quantiles(df, _x(), [0.1, 0.75])
    return (a or 0.0, b if b is not None else 1.0)


def _edges(df: DataFrame, params: dict) -> tuple[float, ...]:
    mean, deviation = df.agg(F.avg(_x()), F.stddev_pop(_x())).first()
    if S.is_coarse(_metres(params["pixel"])):
        return mean or 0.0, 1.5 * (deviation or 0.0), mean or 0.0
    middle, high = quantiles(df, _x(), [0.5, 0.9])
    return middle or 0.0, (high or 0.0) - (middle or 0.0), mean or 0.0


def _metres(pixel: tuple[float, float]) -> float:
    return (abs(pixel[0]) + abs(pixel[1])) / 2


def _longest(*names: str) -> Callable[[dict], float]:
    return lambda p: max((x for n in names for x in ((p.get(n) or ()) if isinstance(p.get(n), (list, tuple)) else (p.get(n) or 0,))), default=1)


_SCALES = _longest("scales")
_RADII = _longest("radii")


def _drift_halo(p: dict) -> float:
    """The wider Gaussian of each pair of scales, two differences, and the window that sums their products."""
    scales = sorted(p["scales"]) if len(p["scales"]) >= 2 else [2, 4, 8, 16, 32]
    return max(len(K.taps(b)) // 2 + len(K.taps(min(max(1.5, a), 24))) // 2 for a, b in zip(scales, scales[1:], strict=False)) + 2


@dataclass(frozen=True)
class Operator:
    """One operator: its kernel, what a radius means to it, its parameters and statistics.

    kind: `smooth` answers the terrain smoothed at each radius, `reach` sets a parameter to
    each radius, `own` takes radii or scales itself.
    """

    kernel: Callable
    halo: Callable[[dict], float]
    params: dict = field(default_factory=dict)
    kind: str = "own"
    reach: str = ""
    auto: bool = False  # radii follow the raster's size
    several: bool = False  # one scale has no meaning
    before: tuple[Callable, tuple[str, ...], Callable[[DataFrame, dict], tuple[float, ...]]] | None = None
    after: Callable[[DataFrame, dict], DataFrame] | None = None
    level: bool = False  # voids are filled with the grid's mean
    metric: bool = False  # takes pixel sizes


def _smooth(kernel: Callable, halo: Callable[[dict], float], **more) -> Operator:
    return Operator(kernel, halo, kind="smooth", auto=True, metric=True, **more)


OPERATORS = {
    "topousm_fast": Operator(K.topousm, lambda p: _RADII(p) + 16, {"radii": None, "weights": None}, auto=True, after=_detail),
    "hillshade": _smooth(K.hillshade, lambda p: 6, params={"azimuth": 315, "altitude": 45, "z_factor": 1, "multiscale": False}),
    "slope": _smooth(K.slope, lambda p: 6, params={"unit": "degree"}),
    "specular": _smooth(K.specular, lambda p: p["roughness_scale"] + 8, params={"roughness_scale": 20, "shininess": 10, "light_azimuth": 315, "light_altitude": 45, "roughness_norm_scale": None}, before=(K.roughness, ("roughness_scale", "holes"), lambda df, p: (_or(quantiles(df, F.when(_x() > 0, _x()), [0.95])[0], 0.0),))),
    "atmospheric_scattering": _smooth(K.atmospheric_scattering, lambda p: 6, params={"scattering_strength": 0.5, "intensity": None}),
    "multiscale_terrain": Operator(K.multiscale_terrain, lambda p: 4 * _SCALES(p) + 1, {"scales": (1, 10, 50, 100), "weights": None}, after=_above(0.01, GAMMA)),
    "visual_saliency": Operator(K.visual_saliency, lambda p: 5 * max(_SCALES(p), 16), {"scales": (2, 4, 8, 16), "weights": None}, several=True, after=_above(None)),
    "curvature": _smooth(K.curvature, lambda p: 8, params={"curvature_type": "mean"}),
    "npr_edges": _smooth(K.npr_edges, lambda p: 4 * max(1, p["edge_sigma"]) + 8, params={"edge_sigma": 1.0, "threshold_low": 0.2, "threshold_high": 0.5}, before=(K.edge_strength, ("edge_sigma", "pixel"), _edges)),
    "blur": Operator(K.blur, lambda p: 4 * (p["radii"][0] if p["radii"] else p["radius"]) + 1, {"radius": 16, "radii": None}),
    "ambient_occlusion": Operator(K.ambient_occlusion, lambda p: p["radius"] + 5, {"num_samples": 16, "radius": 10, "intensity": 1}, kind="reach", reach="radius", auto=True, after=_stretch(0.01, 0.99), metric=True),
    "openness": Operator(K.openness, lambda p: p["max_distance"] + 1, {"openness_type": "positive", "num_directions": 16, "max_distance": 50, "radius": None}, kind="reach", reach="max_distance", auto=True, after=_stretch(0.01, 0.99), metric=True),
    "fractal_anomaly": Operator(K.fractal_anomaly, lambda p: 4 * _RADII(p) + 8, {"radii": None, "weights": None, "smoothing_sigma": 1.2, "detail_boost": 0.35, "despeckle_threshold": 0.35, "despeckle_alpha_max": 0.30}, several=True, before=(K.mean_relief, ("radii",), _relief), metric=True),
    "scale_space_surprise": Operator(K.scale_space_surprise, lambda p: 4 * max(_SCALES(p), 16) + 1, {"scales": (1, 2, 4, 8, 16), "weights": None, "enhancement": 2, "normalize": True}, several=True, after=_surprise),
    "multi_light_uncertainty": _smooth(K.multi_light_uncertainty, lambda p: 6, params={"azimuths": (315, 45, 135, 225), "altitude": 45, "z_factor": 1, "uncertainty_weight": 0.7}),
    "structure_tensor": Operator(K.structure_tensor, lambda p: 2 * _RADII(p) + 4 * p["derivative_sigma"] + 4, {"radii": None, "weights": None, "st_output": "coherence", "azimuth": 315, "derivative_sigma": 1.0}, auto=True, after=_tensor, level=True),
    "frangi": Operator(K.frangi, lambda p: 2 * _RADII(p) + 6, {"radii": None, "beta": 0.5, "feature_type": "both"}, auto=True, before=(K.frangi_size, ("radii", "mean"), lambda df, p: (_or(quantiles(df, _x(), [0.95])[0], 0.0),)), level=True),
    "lic": Operator(K.lic, lambda p: min(p["length"], 120) + 4 * p["flow_sigma"] + 4, {"length": 20, "lic_field": "flow", "composite": "hillshade", "flow_sigma": 1.5, "azimuth": 315, "altitude": 45}, level=True, metric=True),
    "phase_congruency": Operator(K.phase_congruency, lambda p: 2 * max(K.wavelengths(p["radii"])) + 16, {"radii": None, "sigma_onf": 0.55, "noise_k": 2.0, "feature_type": "both"}, several=True, before=(K.phase_amplitude, ("radii", "sigma_onf", "mean"), lambda df, p: (_or(quantiles(df, _x(), [0.5])[0], 1e-12),)), level=True),
    "tv_decomposition": Operator(K.tv_decomposition, lambda p: min(p["iterations"], 140) + 2, {"radii": None, "tv_scale": 32, "iterations": 120, "fidelity": "l1", "component": "texture"}, after=_texture, level=True),
    "scale_drift": Operator(K.scale_drift, _drift_halo, {"scales": (2, 4, 8, 16, 32), "weights": None, "drift_output": "magnitude"}, several=True, after=_drift),
}

RELATIONAL = {
    "hillshade": R.hillshade, "slope": R.slope, "curvature": R.curvature, "atmospheric_scattering": R.atmospheric_scattering,
    "multi_light_uncertainty": R.multi_light_uncertainty,
}

NAMES = tuple(OPERATORS)
#: Parameters that every operator takes.
COMMON = ("mode", "radii", "weights", "agg", "pixel", "intensity", "approx", "skip", "sample")


def default_params(algorithm: str) -> dict:
    """The parameters of an operator and their defaults."""
    return {"mode": "spatial", "radii": None, "weights": None, "agg": "mean", "pixel": (1.0, 1.0)} | OPERATORS[algorithm].params


def _checked(algorithm: str, given: dict) -> None:
    """Names that an operator does not know are errors, as are choices it does not have."""
    op = OPERATORS.get(algorithm)
    if op is None:
        raise ValueError(f"operator {algorithm!r}; known: {', '.join(NAMES)}")
    unknown = set(given) - set(op.params) - set(COMMON)
    if unknown:
        raise ValueError(f"{algorithm} takes no {', '.join(sorted(unknown))}; it takes {', '.join(sorted({*op.params, *COMMON}))}")
    choices = {"mode": ("spatial", "local"), "agg": ("mean", "min", "max", "sum", "stack"), "unit": ("degree", "percent", "radian"), "openness_type": ("positive", "negative"), "st_output": ("coherence", "orientation", "fabric"), "feature_type": ("both", "ridge", "valley", "edge"), "lic_field": ("flow", "contour"), "composite": ("hillshade", "none"), "fidelity": ("l1", "l2"), "component": ("texture", "structure"), "drift_output": ("magnitude", "direction", "divergence")}
    for name, allowed in choices.items():
        if name in given and given[name] not in allowed:
            raise ValueError(f"{name} must be one of {', '.join(allowed)}")


def resolved(algorithm: str, bounds: Bounds, given: dict) -> tuple[list[float], list[float] | None, dict]:
    """Radii, weights and the operator's own parameters for a raster."""
    op = OPERATORS[algorithm]
    mode, radii, weights = given.get("mode", "spatial"), given.get("radii"), given.get("weights")
    own = op.params | {k: v for k, v in given.items() if k in op.params and k not in ("radii", "weights")}
    if mode == "local" and op.several:
        warnings.warn(f"{algorithm} has no meaning at one scale; its scales are kept", stacklevel=3)
        mode = "spatial"
    if mode == "local":
        radii, weights = radii or [1], weights if radii else None
    if op.kind != "own":
        if mode == "local" and not given.get("radii"):
            return [1], [1.0], own
        radii = S.clean_radii(radii, min(bounds.shape))
        return *S.merged(radii, S.clean_weights(weights, len(radii))), own
    if op.auto:
        if algorithm == "topousm_fast" and weights is not None and radii and len(weights) != len(radii):
            raise ValueError("as many weights as radii")
        radii = S.clean_radii(radii, min(bounds.shape))
        radii, weights = S.merged(radii, S.clean_weights(weights, len(radii)))
        own["radii"] = [int(r) for r in radii]
        if "weights" in op.params:
            own["weights"] = weights
        return radii, weights, own
    if "weights" in op.params:
        own["weights"] = weights
    if "scales" in op.params:
        own["scales"] = sorted(float(x) for x in (radii or own["scales"]))
    elif algorithm == "fractal_anomaly":
        radii = S.clean_radii(radii, 0) if radii else S.fractal_radii(_metres(given["pixel"]))
        own["radii"] = sorted(radii) if len(radii) >= 5 else [4, 8, 16, 32, 64]
    elif "radii" in op.params:
        own["radii"] = list(radii) if radii else None
    return [], None, own


class _Overview:
    """An overview of the grid, gathered once; it has at most `most` cells a side."""

    def __init__(self, grid: DataFrame, bounds: Bounds, most: int):
        self.bounds, self.factor = bounds, S.overview_factor(max(bounds.shape), most)
        h, w = (-(-n // self.factor) for n in bounds.shape)
        shifted = grid.select((F.col("r") - bounds.r0).alias("r"), (F.col("c") - bounds.c0).alias("c"), "z")
        cells = R.coarsen(shifted, self.factor).toPandas() if self.factor > 1 else None
        self.z = np.full((h, w), np.nan)
        if cells is not None:
            self.z[cells.r, cells.c] = cells.z.astype(float)

    def sampler(self, field_: np.ndarray) -> Callable[[tuple[int, int], int, int], np.ndarray]:
        """Bilinear values of an overview's field at the centres of a window's pixels."""
        f, b = self.factor, self.bounds

        def sample(shape: tuple[int, int], top: int, left: int) -> np.ndarray:
            y, x = np.meshgrid(*((np.arange(n) + first + 0.5) / f - 0.5 for n, first in zip(shape, (top - b.r0, left - b.c0), strict=True)), indexing="ij")
            return K.bilinear(field_, y, x)

        return sample


def _responses(algorithm: str, op: Operator, radii: list[float], own: dict, pixel: tuple[float, float], stats: dict, overview: _Overview | None, approx: bool) -> list[tuple[float, Callable]]:
    """One function of (array, top, left) for each radius of a `smooth` or `reach` operator."""
    takes = {k: v for k, v in own.items() if k not in ("multiscale", "roughness_norm_scale", "radii", "weights")}
    out = []
    for r in radii:
        more = takes | ({"stat": stats[r]} if stats else {}) | ({"pixel": pixel} if op.metric else {})
        if "holes" in more:
            more["holes"] = more["holes"] and r <= 1
        wide = overview is not None and overview.factor > 1 and r > LARGE
        f = overview.factor if wide else 1
        if op.kind == "reach":
            if r > 1 or op.reach not in own:
                more[op.reach] = max(1, r / f) if len(radii) > 1 or r > 1 else own[op.reach]
        if wide:
            more["pixel"] = (pixel[0] * f, pixel[1] * f)
            if "roughness_scale" in more:
                more["roughness_scale"] = max(3.0, more["roughness_scale"] / f)
            z = overview.z if op.kind == "reach" else K.scaled(overview.z, r / f)
            sample = overview.sampler(op.kernel(z, **more))
            out.append((0, lambda z, top, left, sample=sample: sample(z.shape, top, left)))
        elif op.kind == "reach":
            out.append((op.halo(own | {op.reach: more[op.reach]}), lambda z, top, left, more=more: op.kernel(z, **more)))
        else:
            near = S.shrink_factor(r, algorithm, _metres(pixel)) if approx else 1
            out.append((2 * r + op.halo(own) + near, lambda z, top, left, r=r, more=more, near=near: op.kernel(K.scaled(z, r, near), **more)))
    return out


def tile_function(algorithm: str, bounds: Bounds, **given) -> tuple[Callable, int]:
    """The function of (array, top, left) that answers a tile's window, and its halo, of an operator that needs no statistics."""
    _checked(algorithm, given)
    op = OPERATORS[algorithm]
    pixel = tuple(given.setdefault("pixel", (1.0, 1.0)))
    radii, weights, own = resolved(algorithm, bounds, given)
    if op.before or op.after or op.level or given.get("agg") == "stack":
        raise ValueError(f"{algorithm} needs the whole grid")
    if op.kind == "own":
        return lambda z, top, left: op.kernel(z, **own), int(np.ceil(op.halo(own)))
    parts = _responses(algorithm, op, radii, own, pixel, {}, None, bool(given.get("approx")))
    return lambda z, top, left: K.blend([f(z, top, left) for _, f in parts], weights, given.get("agg", "mean")), int(np.ceil(max(h for h, _ in parts)))


def _statistics(grid: DataFrame, op: Operator, halo: float, tile: int, bounds: Bounds, params: dict, radius: float | None = None) -> tuple[float, ...]:
    kernel, names, sums = op.before
    takes = {k: params[k] for k in names if k in params}
    seen = kept(on_tiles(grid, lambda z, top, left: kernel(z if radius is None else K.scaled(z, radius), **takes), int(halo), tile, bounds=bounds), "statistics")
    return sums(seen, params)


def run(grid: DataFrame, algorithm: str = "topousm_fast", tile: int | None = None, overview: int = OVERVIEW, **given) -> DataFrame:
    """r, c, value of a named operator; agg="stack" adds a column band, one for each radius.

    pixel=(dx, dy) gives signed steps in metres. `approx` smooths at large radii on a coarser
    grid first, which is faster and not exact. `skip` is the share of voids from which a tile
    gives none but NULL. Without `tile` its side follows the halo, a task's memory and the
    cores. Statistics cover the whole grid, or with sample="stratified" nine windows of it.
    """
    _checked(algorithm, given)
    op = OPERATORS[algorithm]
    pixel = tuple(given.setdefault("pixel", (1.0, 1.0)))
    if pixel != (1.0, 1.0) and not op.metric:
        raise ValueError(f"{algorithm} works on cells, not on pixel sizes")
    how, skip = given.get("agg", "mean"), given.get("skip")
    if how == "stack" and op.kind == "own":
        raise ValueError(f"{algorithm} has no responses to stack")
    if "intensity" in given and "intensity" not in op.params:
        given = {k: v for k, v in given.items() if k != "intensity"}  # common, and without effect here
    grid = grid.select("r", "c", F.col("z").cast("double").alias("z"))
    bounds = bounds_of(grid)
    if bounds is None:
        return grid.sparkSession.createDataFrame([], "r long, c long, " + ("band int, " if how == "stack" else "") + "value double")
    radii, weights, own = resolved(algorithm, bounds, given)
    if op.kind == "smooth" and radii == [1] and algorithm in RELATIONAL:
        takes = {k: v for k, v in own.items() if k != "multiscale"}
        df = RELATIONAL[algorithm](grid, pixel=pixel, **takes).toDF("r", "c", "value")
        return df.select("r", "c", F.lit(1).alias("band"), "value") if how == "stack" else df
    if algorithm == "specular":  # its box counts cells beyond the edge unless the grid has voids
        own["holes"] = grid.where("z IS NOT NULL").count() < bounds.shape[0] * bounds.shape[1]
    if op.level:
        own["mean"] = grid.agg(F.avg("z")).first()[0]
    params = own | {"pixel": pixel, "sample": given.get("sample"), "bounds": bounds}
    if tile is None:
        reach = op.halo(own | ({op.reach: max(radii)} if op.kind == "reach" and max(radii) > 1 else {})) + (2 * min(max(radii), LARGE) if op.kind == "smooth" else 0)
        reach = int(min(reach, 2 * LARGE + 16))
        tile = S.auto_tile(reach, max(bounds.shape), grid.sparkSession.sparkContext.defaultParallelism, S.window_budget(reach))
    if op.kind == "own":
        return _own(grid, algorithm, op, tile, bounds, overview, own, params, skip)

    wide = _Overview(grid, bounds, overview) if max(radii) > LARGE and S.overview_factor(max(bounds.shape), overview) > 1 else None
    stats: dict = {}
    if op.before and own.get("roughness_norm_scale"):
        stats = dict.fromkeys(radii, (float(own["roughness_norm_scale"]),))
    elif op.before and algorithm == "specular":
        stats = dict.fromkeys(radii, _statistics(grid, op, op.halo(own), tile, bounds, params))
    elif op.before:
        for r in radii:
            if wide is None or r <= LARGE:
                stats[r] = _statistics(grid, op, 2 * r + op.halo(own), tile, bounds, params, r)
            else:  # one block holds the whole overview
                g = K.edge_strength(K.scaled(wide.z, r / wide.factor), own["edge_sigma"], tuple(p * wide.factor for p in pixel))[np.isfinite(wide.z)]
                stats[r] = (float(np.median(g)), float(np.quantile(g, 0.9) - np.median(g)), float(g.mean()))
    parts = _responses(algorithm, op, radii, own, pixel, stats, wide, bool(given.get("approx")))
    halo, functions = int(np.ceil(max(h for h, _ in parts))), [f for _, f in parts]
    df = on_tiles(grid, lambda z, top, left: K.blend([f(z, top, left) for f in functions], weights, how), halo, tile, bounds=bounds, bands=how == "stack", skip=skip)
    if op.after is None:
        return df
    return _finished(op, df, params)


def _finished(op: Operator, df: DataFrame, params: dict) -> DataFrame:
    """Normalization of the raw responses, which are written once; `sample` takes its statistics from windows."""
    df = kept(df, "responses")
    if params.get("sample") != "stratified":
        return op.after(df, params)
    return op.after(_Sampled(df, R.stratified(df, params["bounds"])), params)


class _Sampled:
    """A DataFrame whose aggregates come from a sample of its rows."""

    def __init__(self, df: DataFrame, sample: DataFrame):
        self.df, self.sample = df, sample
        self.agg, self.select = sample.agg, sample.select

    def withColumn(self, name: str, value: Column) -> DataFrame:  # noqa: N802  as DataFrame has it
        return self.df.withColumn(name, value)


def _own(grid: DataFrame, algorithm: str, op: Operator, tile: int, bounds: Bounds, most: int, own: dict, params: dict, skip: float | None) -> DataFrame:
    """Operators that take radii or scales themselves."""
    takes = {k: v for k, v in own.items() if k != "multiscale"}
    wide_mean = None
    name = {"topousm_fast": "radii", "multiscale_terrain": "scales"}.get(algorithm)
    if name and max(own[name]) > LARGE and S.overview_factor(max(bounds.shape), most) > 1:
        over = _Overview(grid, bounds, most)
        w = own["weights"] if algorithm == "topousm_fast" else K._own_weights(own["weights"], len(own[name])) or (1 / np.array(own[name]) / np.sum(1 / np.array(own[name]))).tolist()
        far = [(r, a) for r, a in zip(own[name], w, strict=True) if r > LARGE]
        near = [(r, a) for r, a in zip(own[name], w, strict=True) if r <= LARGE]
        mean = sum(a * (K.box_scale(over.z, round(r / over.factor)) if name == "radii" else K.valid_smooth(over.z, r / over.factor)) for r, a in far)
        wide_mean, sample = sum(a for _, a in far), over.sampler(mean)
        own = own | {name: [r for r, _ in near] or [1]}
    halo = int(np.ceil(op.halo(own)))
    if op.before:
        takes["stat"] = _statistics(grid, op, halo, tile, bounds, params | {"mean": own.get("mean")})
    if wide_mean is not None:
        around = K.box_scale if name == "radii" else K.valid_smooth

        def kernel(z, top, left):
            small = sum((a * (z - around(z, r)) for r, a in near), np.zeros(z.shape))
            return small + wide_mean * z - sample(z.shape, top, left)

        df = on_tiles(grid, kernel, halo, tile, bounds=bounds, skip=skip)
    elif algorithm == "fractal_anomaly":
        takes = {k: v for k, v in takes.items() if k not in ("despeckle_threshold", "despeckle_alpha_max")}
        raw = kept(on_tiles(grid, lambda z, top, left: K.fractal_anomaly(z, **takes), halo, tile, bounds=bounds, skip=skip), "responses")
        middle = quantiles(raw, _x(), [0.5])[0] or 0.0
        spread = max(_or(quantiles(raw, F.abs(_x() - middle), [0.99])[0], 0.5), 1e-6)
        if own["despeckle_alpha_max"] <= 0.5:  # alpha is never below a half
            return raw.withColumn("value", (_x() - middle) / spread)
        more = {k: own[k] for k in ("despeckle_threshold", "despeckle_alpha_max")}
        return on_tiles(grid, lambda z, top, left: K.fractal_despeckled(z, middle, spread, **more, **takes), halo + 1, tile, bounds=bounds, skip=skip)
    else:
        df = on_tiles(grid, lambda z, top, left: op.kernel(z, **takes), halo, tile, bounds=bounds, skip=skip)
    return df if op.after is None else _finished(op, df, params)


#: What a plug-in has to give: a kernel of an array with NaN for voids, and its halo.
def register(name: str, kernel: Callable[..., np.ndarray], halo: Callable[[dict], float], **more) -> None:
    """Add an operator of one's own under a new name; `more` are fields of Operator."""
    global NAMES
    if name in OPERATORS:
        raise ValueError(f"{name} exists")
    OPERATORS[name] = Operator(kernel, halo, **more)
    NAMES = tuple(OPERATORS)
