"""Scale selection: radii, weights, downsampling and value ranges."""

from __future__ import annotations

import math
import warnings

GAMMA = 1 / 2.2


def auto_radii(short_side: int) -> list[int]:
    # fixed values: the octave ladder
    return [r for r in (2, 8, 32, 128, 512, 2048) if r <= min(short_side / 10, 2048)] or [2]


def auto_weights(n: int) -> list[float]:
    """Each scale weighs half the one before it."""
    return [2.0 ** (n - 1 - i) / (2**n - 1) for i in range(n)]


def clean_radii(radii: list | None, short_side: int) -> list[int]:
    out: list[int] = []
    for r in radii or []:
        try:
            k = round(float(r))
        except (TypeError, ValueError):
            continue
        if k > 0 and k not in out:
            out.append(k)
    return out or auto_radii(short_side)


def clean_weights(weights: list | None, n: int) -> list[float]:
    w = [float(x) if math.isfinite(float(x)) and float(x) > 0 else 0.0 for x in weights or []]
    return [x / sum(w) for x in w] if len(w) == n and sum(w) > 0 else auto_weights(n)


def merged(radii: list[float], weights: list[float]) -> tuple[list[float], list[float]]:
    """Equal radii once, with the sum of their weights; weights add up to one."""
    sums: dict[float, float] = {}
    for r, w in zip(radii, weights, strict=True):
        sums[r] = sums.get(r, 0.0) + w
    total = sum(sums.values()) or 1.0
    return list(sums), [w / total for w in sums.values()]


def resolution_class(pixel: float) -> str:
    # fixed values: the classes' upper bounds in metres
    for most, name in ((0.5, "ultra_high"), (1, "very_high"), (2.5, "high"), (5, "medium"), (15, "low"), (30, "very_low")):
        if pixel <= most:
            return name
    return "ultra_low"


def is_coarse(pixel: float) -> bool:
    return resolution_class(pixel) in ("low", "very_low", "ultra_low")


def edge_sigma(pixel: float) -> float:
    """The smoothing that outlines of a resolution ask for."""
    # fixed values: sigma of each class
    return {"ultra_high": 0.5, "very_high": 0.5, "high": 1.0, "medium": 1.0, "low": 0.5}.get(resolution_class(pixel), 0.3)


def fractal_radii(pixel: float) -> list[int]:
    # fixed values: radii of each resolution class
    table = {
        "ultra_high": [4, 8, 16, 32, 64, 96], "very_high": [4, 8, 16, 24, 32, 48], "high": [4, 8, 16, 32, 48, 64],
        "medium": [3, 6, 12, 24, 36, 48], "low": [2, 4, 8, 16, 24, 32],
    }
    return table.get(resolution_class(pixel), [2, 4, 8, 12, 16, 24])


def shrink_factor(radius: float, algorithm: str, pixel: float = 1.0) -> int:
    """How far a grid may be coarsened before smoothing it at a radius: a power of two up to 16."""
    # fixed values: how much work an operator is
    work = {"topousm_fast": 1.15, "specular": 1.4, "atmospheric_scattering": 1.05, "curvature": 1.1, "ambient_occlusion": 1.5, "openness": 1.4, "multi_light_uncertainty": 1.25}
    score = max(1.0, radius) / 24 * work.get(algorithm, 1.0) * max(1.0, 1 / max(pixel, 1e-3)) ** 0.35
    return 1 if score <= 1 else min(16, 1 << int(math.log2(score)))


def overview_factor(longest: int, most: int = 2048) -> int:
    """The least power of two by which a grid's longest side falls to `most`."""
    return 1 if longest <= most else 1 << math.ceil(math.log2(longest / most))


def window_budget(halo: int, arrays: int = 15) -> int:
    """Bytes of a window's arrays: 64 MB, more where wide halos would else send each cell to over two tiles, and 256 MB at most."""
    return min(256 << 20, max(64 << 20, 8 * arrays * (7 * halo) ** 2))


def auto_tile(halo: int, longest: int, cores: int, budget: int = 256 << 20, arrays: int = 15) -> int:
    """Side of a tile: as large as a task's memory allows with its halo, and small enough to keep all cores busy.

    `arrays` float64 arrays of a window fit into `budget` bytes. A warning tells when halos
    make each cell go to very many tiles.
    """
    most = max(64, halo // 2, math.isqrt(budget // (8 * arrays)) - 2 * halo)
    even = -(-longest // max(1, math.isqrt(2 * cores)))
    side = -(-min(most, max(64, 2 * halo, even)) // 32) * 32
    if ((side + 2 * halo) / side) ** 2 > 16 and longest > side:
        warnings.warn(f"halos of {halo} cells around tiles of {side} send each cell to {((side + 2 * halo) / side) ** 2:.0f} tiles; smaller radii or approx cost less", stacklevel=3)
    return side


def metres_per_degree(latitude: float) -> tuple[float, float]:
    """Of latitude and of longitude (WGS84 series)."""
    a = math.radians(latitude)
    # fixed values: coefficients of the series
    lat = 111132.92 - 559.82 * math.cos(2 * a) + 1.175 * math.cos(4 * a) - 0.0023 * math.cos(6 * a)
    lon = 111412.84 * math.cos(a) - 93.5 * math.cos(3 * a) + 0.118 * math.cos(5 * a)
    return lat, max(1e-6, lon)


def metric_pixel(x: float, y: float, latitude: float | None = None) -> tuple[float, float]:
    """Signed steps in metres; with a centre latitude x and y are degrees of longitude and latitude."""
    if not x or not y:
        raise ValueError("pixel sizes must not be 0")
    lat, lon = (1.0, 1.0) if latitude is None else metres_per_degree(latitude)
    return x * lon, y * lat


# Native ranges of results.
RANGES = {
    "topousm_fast": (-1.176, 1.176), "fractal_anomaly": (-1.176, 1.176), "slope": (0, 90), "npr_edges": (0.2, 1),
    "multiscale_terrain": (0, 1.176), "visual_saliency": (0, 1.176), "scale_space_surprise": (0, 1.176), "structure_tensor": (0, 1.176), "scale_drift": (0, 1.176),
    "hillshade": (0, 1), "specular": (0, 1), "atmospheric_scattering": (0, 1), "curvature": (0, 1), "multi_light_uncertainty": (0, 1), "ambient_occlusion": (0, 1),
    "openness": (0, 1), "frangi": (0, 1), "lic": (0, 1), "phase_congruency": (0, 1), "tv_decomposition": (0, 1),
}


def quantizer(kind: str, low: float, high: float) -> tuple[float, float, int, int]:
    """Factor, offset and code bounds of int16 or uint8 codes; 0 is NoData."""
    top = {"int16": 32767, "uint8": 255}[kind]
    if high <= low:
        raise ValueError("range must rise")
    if low < 0:
        a = max(-low, high)
        return (32767 / a, 0.0, -32767, 32767) if kind == "int16" else (127 / a, 128.0, 1, 255)
    a = (top - 1) / (high - low)
    return a, 1 - a * low, 1, top
