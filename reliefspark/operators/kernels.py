"""Array forms of the terrain operators, for tiles with halo. NaN is NoData."""

from __future__ import annotations

import numpy as np

from ..functions import scales as S
from ..functions.scales import GAMMA

#: Cells of a strip that is weighed at once.
STRIP = 1 << 16


def taps(sigma: float, order: int = 0) -> np.ndarray:
    n = int(4 * sigma + 0.5)
    k = np.arange(-n, n + 1)
    w = np.exp(-(k**2) / (2 * sigma**2))
    w /= w.sum()
    return w if order == 0 else k / sigma**2 * w if order == 1 else (k**2 / sigma**4 - 1 / sigma**2) * w


def along(z: np.ndarray, w: np.ndarray, axis: int, mode: str = "edge") -> np.ndarray:
    """Correlation with centred weights along one axis."""
    n = len(w) // 2
    pad = [(0, 0), (0, 0)]
    pad[axis] = (n, n)
    p = np.pad(z, pad, mode=mode)
    out, (h, width) = np.zeros(z.shape), z.shape
    rows = max(1, STRIP // max(1, width))
    for y in range(0, h, rows):  # strips stay in the cache, and no copy of the whole array is made for each weight
        strip = out[y : y + rows]
        for i, v in enumerate(w):
            strip += v * (p[y + i : y + i + len(strip)] if axis == 0 else p[y : y + len(strip), i : i + width])
    return out


def smooth(z: np.ndarray, sigma: float, mode: str = "edge") -> np.ndarray:
    return along(along(z, taps(sigma), 0, mode), taps(sigma), 1, mode)


def valid_smooth(z: np.ndarray, sigma: float, mode: str = "edge") -> np.ndarray:
    """Gaussian of valid cells by their weight; 0 where none reaches."""
    ok = np.isfinite(z)
    if ok.all():
        return smooth(z, sigma, mode)
    top, low = smooth(np.where(ok, z, 0.0), sigma, mode), smooth(ok.astype(float), sigma, mode)
    return np.where(low > 0, top / np.where(low > 0, low, 1), 0.0)


def box(z: np.ndarray, size: int, mode: str = "symmetric") -> np.ndarray:
    def one(x: np.ndarray, axis: int) -> np.ndarray:
        pad = [(0, 0), (0, 0)]
        pad[axis] = (size // 2, size - 1 - size // 2)
        s = np.cumsum(np.insert(np.pad(x, pad, mode=mode), 0, 0, axis), axis)
        n = x.shape[axis]
        return (np.take(s, np.arange(size, size + n), axis) - np.take(s, np.arange(n), axis)) / size

    return one(one(z, 0), 1)


def valid_box(z: np.ndarray, size: int, mode: str = "symmetric", holes: bool | None = None) -> np.ndarray:
    """Box mean of valid cells; without holes in the grid (or, if that is not said, in the array) of all cells of the box."""
    ok = np.isfinite(z)
    if ok.all() if holes is None else not holes:
        return box(z, size, mode)
    low = box(ok.astype(float), size, mode)
    return np.where(low > 1e-12, box(np.where(ok, z, 0.0), size, mode) / np.maximum(low, 1e-12), 0.0)


def filled(z: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    ok = np.isfinite(z)
    return z if ok.all() else np.where(ok, z, valid_smooth(z, sigma))


def gradient(z: np.ndarray, step: float | tuple[float, float] = 1.0, edge_order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    dx, dy = step if isinstance(step, (tuple, list)) else (step, step)
    q, p = np.gradient(filled(z), dy, dx, edge_order=edge_order if min(z.shape) > 2 else 1)
    return p, q


def levelled(z: np.ndarray, mean: float | None = None) -> np.ndarray:
    """Voids at the grid's mean, which every tile must know alike."""
    ok = np.isfinite(z)
    return z if ok.all() else np.where(ok, z, mean if mean is not None else z[ok].mean() if ok.any() else 0.0)


def shrunk(z: np.ndarray, f: int) -> np.ndarray:
    """Means of the valid cells of f x f blocks; small enclosed voids are filled, wide ones stay."""
    h, w = (-(-n // f) for n in z.shape)
    p = np.pad(z, ((0, h * f - z.shape[0]), (0, w * f - z.shape[1])), constant_values=np.nan).reshape(h, f, w, f)
    n = np.isfinite(p).sum((1, 3))
    out = np.where(n > 0, np.nansum(p, (1, 3)) / np.maximum(n, 1), np.nan)
    if (n == 0).any():
        sigma = max(1.0, min(h, w) / 64)
        near = smooth((n > 0).astype(float), sigma)
        out = np.where((n == 0) & (near > 0.5), smooth(np.nan_to_num(out), sigma) / np.maximum(near, 1e-6), out)
    return out


def grown(z: np.ndarray, f: int, shape: tuple[int, int]) -> np.ndarray:
    """Bilinear values at the centres of the cells that were shrunk; voids where no valid cell is near."""
    y, x = np.meshgrid(*((np.arange(n) + 0.5) / f - 0.5 for n in shape), indexing="ij")
    ok = np.isfinite(z)
    if ok.all():
        return bilinear(z, y, x)
    near = bilinear(ok.astype(float), y, x)
    return np.where(near > 1e-3, bilinear(np.where(ok, z, 0.0), y, x) / np.maximum(near, 1e-6), np.nan)


def scaled(z: np.ndarray, radius: float, factor: int = 1) -> np.ndarray:
    """The terrain as a radius shows it; by a factor coarser first, which is faster and not exact."""
    if radius <= 1:
        return z
    if factor > 1:
        return grown(valid_smooth(shrunk(z, factor), max(0.5, radius / factor / 2)), factor, z.shape)
    return valid_smooth(z, max(0.5, radius / 2))


def blend(fields: list[np.ndarray], weights: list[float] | None, how: str = "mean") -> np.ndarray:
    """Responses of several scales in one; near scales weigh most unless weights are given."""
    if how == "stack":
        return np.stack(fields)
    if how in ("min", "max", "sum"):
        return {"min": np.min, "max": np.max, "sum": np.sum}[how](fields, axis=0)
    return sum(a * x for a, x in zip(S.clean_weights(weights, len(fields)), fields, strict=True))


def _own_weights(weights: list[float] | None, n: int) -> list[float] | None:
    """Weights that fit an operator's own scales, or None: it keeps its own."""
    if weights is None or len(weights) != n or not sum(w for w in weights if np.isfinite(w) and w > 0):
        return None
    return S.clean_weights(weights, n)


def light(azimuth: float, altitude: float) -> tuple[float, float, float]:
    a, h = np.radians(azimuth), np.radians(altitude)
    return np.sin(a) * np.cos(h), np.cos(a) * np.cos(h), np.sin(h)


def lambert(p: np.ndarray, q: np.ndarray, azimuth: float = 315, altitude: float = 45) -> np.ndarray:
    x, y, up = light(azimuth, altitude)
    return (-p * x - q * y + up) / np.sqrt(p * p + q * q + 1)


def clip(x: np.ndarray, low: float = 0.0, high: float = 1.0) -> np.ndarray:
    return np.clip(x, low, high)


def hillshade(z, azimuth=315, altitude=45, z_factor=1, pixel=(1.0, 1.0)):
    return clip(lambert(*gradient(z * z_factor, pixel), azimuth, altitude))


def slope(z, unit="degree", pixel=(1.0, 1.0)):
    steep = np.arctan(np.hypot(*gradient(z, pixel)))
    return np.degrees(steep) if unit == "degree" else np.tan(steep) * 100 if unit == "percent" else steep


def curvature(z, curvature_type="mean", pixel=(1.0, 1.0)):
    dx, dy = map(abs, pixel)
    p, q = gradient(z, (dx, dy))
    (py, r), (t, qx) = (np.gradient(x, dy, dx, edge_order=2) for x in (p, q))
    g, s = p * p + q * q, (py + qx) / 2
    if curvature_type == "mean":
        k = -((1 + q * q) * r - 2 * p * q * s + (1 + p * p) * t) / (2 * (1 + g) ** 1.5 + 1e-10)
    elif curvature_type == "gaussian":
        k = (r * t - py * py) / (1 + g) ** 2
    elif curvature_type == "planform":
        k = -(q * q * r - 2 * p * q * py + p * p * t) / (g**1.5 + 1e-10)
    else:
        k = -(p * p * r + 2 * p * q * py + q * q * t) / (g * (1 + g) ** 1.5 + 1e-10)
    return ((np.tanh(100 * k) + 1) / 2) ** GAMMA


def atmospheric_scattering(z, scattering_strength=0.5, intensity=None, pixel=(1.0, 1.0)):
    p, q = gradient(z, pixel)
    mass = 1 / (np.cos(np.arctan(np.hypot(p, q))) + 0.001)
    haze = 1 - np.exp(-(scattering_strength if intensity is None else intensity) * mass)
    return clip(0.3 * (0.4 + 0.6 * haze) + 0.7 * clip(lambert(p, q))) ** GAMMA


def multi_light_uncertainty(z, azimuths=(315, 45, 135, 225), altitude=45, z_factor=1, uncertainty_weight=0.7, pixel=(1.0, 1.0)):
    if not len(azimuths):
        raise ValueError("no azimuths")
    p, q = gradient(z * z_factor, pixel)
    lights = [np.maximum(0, lambert(p, q, a, altitude)) for a in azimuths]
    mean = np.mean(lights, axis=0)
    return clip(mean + uncertainty_weight * clip(np.std(lights, axis=0) / (mean + 1e-6)))


def blur(z, radius=16, radii=None):
    return valid_smooth(z, max(0.5, radii[0] if radii else radius))


def high_pass(z, sigma=16):
    """What a Gaussian takes away."""
    return z - valid_smooth(z, sigma)


def box_scale(z, r):
    """The mean around each cell at a radius."""
    return valid_smooth(z, 1) if r <= 1 else valid_box(z, 2 * int(r) + 1)


def topousm(z, radii=(2, 8), weights=None, wide=None):
    """Weighted height above the surroundings; `wide` is the weighted mean at radii known from an overview, with their weight."""
    if weights is not None and len(weights) != len(radii):
        raise ValueError("as many weights as radii")
    w = S.auto_weights(len(radii)) if weights is None else weights
    out = sum((a * (z - box_scale(z, r)) for a, r in zip(w, radii, strict=True)), np.zeros(z.shape))
    return out if wide is None else out + wide[0] * z - wide[1]


def multiscale_terrain(z, scales=(1, 10, 50, 100), weights=None, wide=None):
    w = _own_weights(weights, len(scales)) or (1 / np.array(scales, float) / np.sum(1 / np.array(scales, float))).tolist()
    out = sum((a * (z - valid_smooth(z, s)) for a, s in zip(w, scales, strict=True)), np.zeros(z.shape))
    return out if wide is None else out + wide[0] * z - wide[1]


def roughness(z, roughness_scale=20, holes=None):
    n = max(3, int(roughness_scale))
    mean, square = valid_box(z, n, "constant", holes), valid_box(z * z, n, "constant", holes)
    return np.sqrt(np.maximum(square - mean * mean, 0))


def specular(z, roughness_scale=20, shininess=10, light_azimuth=315, light_altitude=45, intensity=1, stat=(1.0,), pixel=(1.0, 1.0), holes=None):
    rough, azimuth, altitude = roughness(z, roughness_scale, holes), light_azimuth, light_altitude
    d = stat[0] or 0.0
    rho = clip(rough / (rough + d), 0.05, 1) if d > 1e-9 else np.full(z.shape, 0.5)
    p, q = gradient(z, pixel)
    norm = np.sqrt(p * p + q * q + 1)
    x, y, up = light(azimuth, altitude)
    half = np.array([x, y, up + 1]) / np.sqrt(x * x + y * y + (up + 1) ** 2)
    facing, high = clip((-p * half[0] - q * half[1] + half[2]) / norm), 1 / norm
    s = clip(facing ** (shininess * (1 - 0.8 * rho)))
    s = clip(s * (0.95 + 0.70 * (1 - rho)))
    s = clip(s * (0.80 + 0.45 * (0.06 + 0.94 * (1 - clip(high)) ** 5)))
    s = s / (1 + 0.35 * s)
    out = clip(0.36 * 0.28 * clip(lambert(p, q, azimuth, altitude)) + 0.64 * s) ** 0.88
    out = clip(out + 0.10 * (s - smooth(s, 1.1)) * (1 - 0.6 * rho))
    return clip(0.04 + 0.92 * clip(0.5 + 0.5 * np.tanh((out - 0.5) / 0.82)))


def visual_saliency(z, scales=(2, 4, 8, 16), weights=None):
    scales = scales if len(scales) >= 4 else (2, 4, 8, 16)
    w = _own_weights(weights, len(scales))
    s = [valid_smooth(z, k) for k in scales]
    pairs = [(a, b) for a, b in ((0, 2), (0, 3), (1, 3), (1, 4)) if b < len(s)]
    intensity = np.average([np.log1p(np.abs(s[a] - s[b])) for a, b in pairs], axis=0, weights=w and _positive([w[a] for a, _ in pairs]))
    maps = []
    for x in s[:3]:
        q, p = np.gradient(x)
        angle, size = np.arctan2(q, p), np.hypot(p, q)
        maps += [np.log1p(size * np.maximum(np.cos(2 * (angle - o)), 0)) for o in np.arange(4) * np.pi / 4]
    return 0.5 * (intensity + np.average(maps, axis=0, weights=w and _positive([w[i] for i in range(3) for _ in range(4)])))


def _positive(w: list[float]) -> list[float] | None:
    return w if sum(w) > 0 else None


def neighbours(z: np.ndarray, mode: str = "edge") -> list[np.ndarray]:
    p = np.pad(z, 1, mode=mode)
    return [p[i : i + z.shape[0], j : j + z.shape[1]] for i in range(3) for j in range(3)]


def edge_field(z, edge_sigma=1.0, pixel=(1.0, 1.0)):
    """Gradient of the smoothed terrain: size, and direction in degrees."""
    metres = (abs(pixel[0]) + abs(pixel[1])) / 2
    sigma = S.edge_sigma(metres) if edge_sigma == 1.0 else edge_sigma
    n = neighbours(valid_smooth(z, sigma) if sigma > 0.1 else filled(z))
    gx = (n[2] + 2 * n[5] + n[8] - n[0] - 2 * n[3] - n[6]) / 8
    gy = (n[6] + 2 * n[7] + n[8] - n[0] - 2 * n[1] - n[2]) / 8
    g = np.hypot(gx, gy)
    if S.is_coarse(metres):
        g = np.maximum(g, 0.3 * (np.max(n, axis=0) - np.min(n, axis=0)))
    return g, np.degrees(np.arctan2(gy, gx)) % 180


def edge_strength(z, edge_sigma=1.0, pixel=(1.0, 1.0)):
    return edge_field(z, edge_sigma, pixel)[0]


def npr_edges(z, edge_sigma=1.0, threshold_low=0.2, threshold_high=0.5, stat=(0.0, 1.0, 0.0), pixel=(1.0, 1.0)):
    """Outlines; stat holds base, span and mean of the gradient over the whole grid."""
    g, angle = edge_field(z, edge_sigma, pixel)
    base, span, mean = stat
    lo, hi = max(base + span * threshold_low * 0.5, 0.1 * mean), max(base + span * threshold_high, 0.2 * mean)
    n = neighbours(g, "constant")
    side = (np.floor((angle + 22.5) / 45).astype(int)) % 4
    a, b = (np.choose(side, [n[i] for i in pick]) for pick in ((5, 8, 7, 6), (3, 0, 1, 2)))
    peak = (g >= a) & (g >= b)
    edge = np.where(peak & (g >= hi), 1.0, np.where(peak & (g >= lo), 0.5, 0.0))
    for _ in range(3):
        edge = np.where((edge == 0.5) & (np.max(neighbours(edge, "constant"), axis=0) > 0.5), 1.0, edge)
    if S.is_coarse((abs(pixel[0]) + abs(pixel[1])) / 2):
        edge = np.maximum(edge, 0.8 * np.max(neighbours(edge, "constant"), axis=0))
    return clip(1 - 0.8 * edge, 0.2, 1) ** GAMMA


def shifted(z: np.ndarray, dy: int, dx: int, outside: float | None) -> np.ndarray:
    y, x = np.arange(z.shape[0]) + dy, np.arange(z.shape[1]) + dx
    out = z[np.clip(y, 0, z.shape[0] - 1)][:, np.clip(x, 0, z.shape[1] - 1)]
    if outside is not None:
        out = out.copy()
        out[(y < 0) | (y >= z.shape[0])] = outside
        out[:, (x < 0) | (x >= z.shape[1])] = outside
    return out


def ambient_occlusion(z, num_samples=16, radius=10, intensity=1, pixel=(1.0, 1.0)):
    samples, (px, py) = num_samples, pixel
    total, count = np.zeros(z.shape), np.zeros(z.shape)
    for f in (0.25, 0.5, 0.75, 1.0):
        for k in range(samples):
            a = 2 * np.pi * k / samples
            dx, dy = round(radius * f * np.cos(a)), round(radius * f * np.sin(a))
            if dx == dy == 0:
                continue
            up = shifted(z, dy, dx, None) - z
            ok = np.isfinite(up)
            steep = np.minimum(np.maximum(0, np.arctan(np.where(ok, up, 0) / np.hypot(dx * px, dy * py))) / (np.pi / 4), 1)
            total += np.where(ok, steep * (1 - 0.3 * f), 0)
            count += ok
    out = clip(1 - total / np.maximum(count, 1) * intensity)
    return smooth(np.where(np.isfinite(z), out, 1.0), 1) ** GAMMA


def openness(z, openness_type="positive", num_directions=16, max_distance=50, radius=None, pixel=(1.0, 1.0)):
    rings = [d for d in np.unique((np.linspace(0.1, 1, 10) * max_distance).astype(int)) if d > 0]
    directions, (px, py) = num_directions, pixel
    sign, total, count = 1 if openness_type == "positive" else -1, np.zeros(z.shape), np.zeros(z.shape)
    for k in range(directions):
        a, far, seen = 2 * np.pi * k / directions, np.full(z.shape, -np.pi / 2), np.zeros(z.shape, bool)
        for d in rings:
            dx, dy = round(d * np.cos(a)), round(d * np.sin(a))
            if dx == dy == 0:
                continue
            rise = sign * (shifted(z, dy, dx, np.nan) - z) / np.hypot(dx * px, dy * py)
            ok = np.isfinite(rise)
            far, seen = np.where(ok, np.maximum(far, np.arctan(np.where(ok, rise, 0))), far), seen | ok
        total += np.where(seen, np.pi / 2 - far, 0)
        count += seen
    return clip(np.where(count > 0, total / np.maximum(count, 1), 0) / (np.pi / 2)) ** GAMMA


def reliefs(z, radii=(4, 8, 16, 32, 64)):
    out = []
    for r in radii:
        s = max(0.8, r / 2)
        flat = z - valid_smooth(z, s)
        out.append(np.maximum(np.sqrt(np.maximum(valid_smooth(flat * flat, s), 0)), 1e-8))
    return out


def mean_relief(z, radii=(4, 8, 16, 32, 64)):
    return np.mean(reliefs(z, radii), axis=0)


def fractal_anomaly(z, radii=(4, 8, 16, 32, 64), weights=None, smoothing_sigma=1.2, detail_boost=0.35, stat=(0.0, 1.0), parts=False):
    """The feature; with `parts` also alpha and the relief's confidence, which despeckling needs."""
    rough, boost = reliefs(z, radii), detail_boost
    n, w = len(radii), np.array(_own_weights(weights, len(radii)) or np.sqrt(radii) / np.sqrt(radii).sum())
    x, y = np.log(radii), [np.log(np.maximum(r, 1e-5)) for r in rough]
    mx, my = float(w @ x), sum(a * b for a, b in zip(w, y, strict=True))
    beta = sum(a * (i - mx) * (j - my) for a, i, j in zip(w, x, y, strict=True)) / (float(w @ (x - mx) ** 2) + 1e-10)
    left = sum(a * (j - (my + beta * (i - mx))) ** 2 for a, i, j in zip(w, x, y, strict=True))
    whole = sum(a * (j - my) ** 2 for a, j in zip(w, y, strict=True))
    fit = clip(1 - left / (whole + 1e-10))
    sure = clip((np.mean(rough, axis=0) - stat[0]) / max(stat[1] - stat[0], 1e-6))
    f = 0.75 * clip(beta - 1.2, -4, 4) + 0.45 * np.log1p(np.sqrt(left)) + 0.35 * (y[-1] - y[max(n - 3, 0)]) * sure + 0.18 * boost * (y[0] - y[min(2, n - 1)]) * sure
    a = 0.5 + 0.5 * clip((fit - 0.35) / 0.6) * sure
    out = a * f + (1 - a) * valid_smooth(np.where(np.isfinite(z), f, np.nan), smoothing_sigma)
    return (out, a, sure) if parts else out


def fractal_despeckled(z, middle=0.0, spread=1.0, despeckle_threshold=0.35, despeckle_alpha_max=0.30, **p):
    """The normalized feature; single cells that stand out where alpha and relief are low take the median of their 3 x 3 cells."""
    f, a, sure = fractal_anomaly(z, parts=True, **p)
    x = (f - middle) / spread
    med = np.median(neighbours(x), axis=0)
    return np.where((np.abs(x - med) > max(0.05, despeckle_threshold) * (0.7 + 1.1 * a)) & (a < despeckle_alpha_max) & (sure < 0.45), med, x)


def scale_space_surprise(z, scales=(1, 2, 4, 8, 16), weights=None, enhancement=2, normalize=True):
    scales = sorted(scales if len(scales) >= 2 else (1, 2, 4, 8, 16))
    s = [valid_smooth(z, k, "symmetric") for k in scales]
    w = _own_weights(weights, len(scales))
    pairs = None if w is None else _positive([(a + b) / 2 for a, b in zip(w, w[1:], strict=False)])
    return np.average([np.abs(b - a) for a, b in zip(s, s[1:], strict=False)], axis=0, weights=pairs)


def derivatives(z, sigma, ny, nx):
    return along(along(z, taps(sigma, ny), 0), taps(sigma, nx), 1)


def structure_tensor(z, radii=(2, 8), weights=None, st_output="coherence", azimuth=315, derivative_sigma=1.0, mean=None):
    x, us, vs, output, sigma = levelled(z, mean), [], [], st_output, max(0.5, derivative_sigma)
    p, q = derivatives(x, sigma, 0, 1), derivatives(x, sigma, 1, 0)
    for r in radii:
        s = max(1, r / 2)
        jxx, jyy, jxy = smooth(p * p, s), smooth(q * q, s), smooth(p * q, s)
        spread = np.sqrt((jxx - jyy) ** 2 + 4 * jxy**2)
        c = (spread / (jxx + jyy + 1e-12)) ** 2
        us.append(-c * (jxx - jyy) / np.maximum(spread, 1e-30))
        vs.append(-c * 2 * jxy / np.maximum(spread, 1e-30))
    u, v = blend(us, weights), blend(vs, weights)
    if output == "orientation":
        return (0.5 * np.arctan2(v, u) / np.pi) % 1
    a = np.arctan2(-np.cos(np.radians(azimuth)), np.sin(np.radians(azimuth)))
    return np.hypot(u, v) if output == "coherence" else 0.5 + 0.5 * (u * np.cos(2 * a) + v * np.sin(2 * a))


def _hessian(z, radius, mean=None):
    s = max(0.8, radius / 2)
    x = levelled(z, mean)
    hxx, hyy, hxy = (derivatives(x, s, *o) * s * s for o in ((0, 2), (2, 0), (1, 1)))
    root = np.sqrt(0.25 * (hxx - hyy) ** 2 + hxy**2)
    a, b = 0.5 * (hxx + hyy) + root, 0.5 * (hxx + hyy) - root
    swap = np.abs(a) > np.abs(b)
    return np.where(swap, b, a), np.where(swap, a, b)


def frangi_size(z, radii=(2, 8), mean=None):
    return np.max([np.sqrt(a * a + b * b) for a, b in (_hessian(z, r, mean) for r in radii)], axis=0)


def frangi(z, radii=(2, 8), beta=0.5, feature_type="both", stat=(1.0,), mean=None):
    best, c, feature = {}, max(stat[0] / 2, 1e-12), feature_type
    for r in radii:
        a, b = _hessian(z, r, mean)
        v = np.exp(-((a / np.where(b >= 0, b + 1e-12, b - 1e-12)) ** 2) / (2 * beta**2)) * (1 - np.exp(-(a * a + b * b) / (2 * c * c)))
        for k, side in (("ridge", b < 0), ("valley", b > 0)):
            best[k] = np.maximum(best.get(k, 0), np.where(side, v, 0))
    return best[feature] if feature in best else 0.5 + 0.5 * clip(best["ridge"] - best["valley"], -1, 1)


def bilinear(z, y, x):
    y, x = np.clip(y, 0, z.shape[0] - 1), np.clip(x, 0, z.shape[1] - 1)
    i, j = np.minimum(y.astype(int), max(z.shape[0] - 2, 0)), np.minimum(x.astype(int), max(z.shape[1] - 2, 0))
    i2, j2 = np.minimum(i + 1, z.shape[0] - 1), np.minimum(j + 1, z.shape[1] - 1)
    a, b = y - i, x - j
    return (z[i, j] * (1 - b) + z[i, j2] * b) * (1 - a) + (z[i2, j] * (1 - b) + z[i2, j2] * b) * a


def lic(z, length=20, lic_field="flow", flow_sigma=1.5, composite="hillshade", azimuth=315, altitude=45, pixel=(1.0, 1.0), mean=None):
    x = levelled(z, mean)
    noise = np.mod(np.sin(x * 127.1 + 311.7) * 43758.5453123, 1.0)
    q, p = np.gradient(smooth(x, flow_sigma))
    shade = clip(lambert(p / abs(pixel[0]), q / abs(pixel[1]), azimuth, altitude))
    if lic_field == "contour":
        p, q = -q, p
    size = np.hypot(p, q)
    u, v = (np.where(size > 1e-12, w / np.maximum(size, 1e-12), 0) for w in (p, q))
    gy, gx = np.mgrid[: z.shape[0], : z.shape[1]].astype(float)
    total = noise.copy()
    for way in (1, -1):
        y, xx = gy.copy(), gx.copy()
        for _ in range(min(int(length), 120)):
            dy, dx = bilinear(v, y, xx), bilinear(u, y, xx)
            y, xx = y + way * dy, xx + way * dx
            total += bilinear(noise, y, xx)
    n = 2 * min(int(length), 120) + 1
    out = clip(0.5 + (total / n - 0.5) * np.sqrt(n))
    return out * shade if composite == "hillshade" else out


def wavelengths(radii) -> list[float]:
    waves = list(dict.fromkeys(min(64.0, max(3.0, float(r))) for r in radii or ()))
    return sorted(waves) if len(waves) >= 2 else [4, 8, 16, 32, 64]


def _phase(z, waves, sigma, mean):
    x = levelled(z, mean)
    x = x - x.mean()
    fy, fx = np.fft.fftfreq(z.shape[0])[:, None], np.fft.fftfreq(z.shape[1])[None, :]
    rho = np.hypot(fy, fx)
    rho[0, 0] = 1
    lowpass, spectrum = 1 / (1 + (rho / 0.45) ** 20), np.fft.fft2(x)
    evens, odds, sizes = [], [], []
    for w in waves:
        g = np.exp(-(np.log(rho * w) ** 2) / (2 * np.log(sigma) ** 2)) * lowpass
        g[0, 0] = 0
        e = np.fft.ifft2(spectrum * g).real
        ox, oy = np.fft.ifft2(spectrum * g * 1j * fx / rho).real, np.fft.ifft2(spectrum * g * 1j * fy / rho).real
        evens.append(e)
        odds.append((ox, oy))
        sizes.append(np.sqrt(e * e + ox * ox + oy * oy))
    return evens, odds, sizes


def phase_amplitude(z, radii=None, sigma_onf=0.55, mean=None):
    """Amplitude of the shortest wave, whose median over the grid tells the noise."""
    return _phase(z, wavelengths(radii)[:1], sigma_onf, mean)[2][0]


def phase_congruency(z, radii=None, sigma_onf=0.55, noise_k=2.0, feature_type="both", stat=None, mean=None):
    waves, k, feature = wavelengths(radii), noise_k, feature_type
    evens, odds, sizes = _phase(z, waves, sigma_onf, mean)
    even = np.sum(evens, axis=0)
    energy = np.sqrt(even**2 + sum(o[0] for o in odds) ** 2 + sum(o[1] for o in odds) ** 2)
    tau = (np.median(sizes[0]) if stat is None else stat[0]) / np.sqrt(np.log(4)) * sum(np.sqrt(waves[0] / w) for w in waves)
    noise = tau * np.sqrt(np.pi / 2) + k * tau * np.sqrt((4 - np.pi) / 2)
    total = np.sum(sizes, axis=0)
    width = total / (np.max(sizes, axis=0) + 1e-6) / len(waves)
    pc = np.maximum(energy - noise, 0) / (total + 1e-6) / (1 + np.exp(10 * (0.5 - width)))
    if feature == "edge":
        return pc * (1 - np.abs(even) / (energy + 1e-12))
    if feature in ("ridge", "valley"):
        return np.where(even > 0 if feature == "ridge" else even < 0, pc, 0)
    return 0.5 + 0.5 * np.sign(even) * pc


def tv_decomposition(z, radii=None, tv_scale=32, iterations=120, fidelity="l1", component="texture", mean=None):
    f, scale = levelled(z, mean), max(2.0, float(radii[0] if radii else tv_scale))
    u, bar, py, px, lam, tau = f.copy(), f.copy(), np.zeros(z.shape), np.zeros(z.shape), 4 / scale, 0.25
    for _ in range(int(np.clip(iterations, 10, 140))):
        gy, gx = np.zeros(z.shape), np.zeros(z.shape)
        gy[:-1], gx[:, :-1] = np.diff(bar, axis=0), np.diff(bar, axis=1)
        py, px = py + 0.5 * gy, px + 0.5 * gx
        size = np.maximum(1, np.hypot(py, px))
        py, px = py / size, px / size
        div = py + px
        div[1:] -= py[:-1]
        div[:, 1:] -= px[:, :-1]
        old, v = u, u + tau * div
        u = np.where(np.abs(v - f) <= tau * lam, f, v - np.sign(v - f) * tau * lam) if fidelity == "l1" else (v + tau * lam * f) / (1 + tau * lam)
        bar = 2 * u - old
    return u if component == "structure" else f - u


def scale_drift(z, scales=(2, 4, 8, 16, 32), weights=None, drift_output="magnitude"):
    scales, output = sorted(scales) if len(scales) >= 2 else [2, 4, 8, 16, 32], drift_output
    own = _own_weights(weights, len(scales))
    shares = None if own is None else _positive([(a + b) / 2 for a, b in zip(own, own[1:], strict=False)])
    shares = [x / sum(shares) for x in shares] if shares else [1 / (len(scales) - 1)] * (len(scales) - 1)
    s = [valid_smooth(z, k) for k in scales]
    dx, dy = np.zeros(z.shape), np.zeros(z.shape)
    for a, b, x, y, part in zip(scales, scales[1:], s, s[1:], shares, strict=False):
        t, (q, p), w = y - x, np.gradient((x + y) / 2), min(max(1.5, a), 24)
        jxx, jyy, jxy, bx, by = (smooth(v, w) for v in (p * p, q * q, p * q, p * t, q * t))
        damp = 1e-3 * (jxx + jyy) + 1e-12
        jxx, jyy = jxx + damp, jyy + damp
        det = jxx * jyy - jxy**2
        share = part / (b - a)
        dx += -(jyy * bx - jxy * by) / det * share
        dy += -(jxx * by - jxy * bx) / det * share
    if output == "direction":
        return (np.arctan2(dy, dx) / (2 * np.pi)) % 1
    return np.hypot(dx, dy) if output == "magnitude" else np.gradient(dx, axis=1) + np.gradient(dy, axis=0)


def push_pull(z: np.ndarray) -> np.ndarray:
    """Fill every void from a pyramid of valid means; valid cells stay; all void gives zeros."""
    ok = np.isfinite(z)
    if not ok.any():
        return np.zeros(z.shape)
    levels = [(np.where(ok, z, 0.0), ok.astype(float))]
    while levels[-1][1].min() <= 1e-6 and max(levels[-1][0].shape) > 1:
        v, w = levels[-1]
        v, w = (np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2))) for a in (v * w, w))
        v, w = (a.reshape(a.shape[0] // 2, 2, a.shape[1] // 2, 2).sum((1, 3)) for a in (v, w))
        levels.append((np.where(w > 0, v / np.maximum(w, 1e-12), 0), np.minimum(w, 1)))
    out = levels[-1][0]
    for v, w in reversed(levels[:-1]):
        y, x = (np.arange(n) + 0.5 for n in v.shape)
        up = bilinear(out, np.repeat((y / 2 - 0.5)[:, None], v.shape[1], 1), np.repeat((x / 2 - 0.5)[None, :], v.shape[0], 0))
        out = np.where(w > 1e-6, v, up)
    return np.where(ok, z, out)


def exterior(z: np.ndarray) -> np.ndarray:
    """Void cells joined to the border through void cells (4 neighbours)."""
    void = ~np.isfinite(z)
    out = void.copy()
    out[1:-1, 1:-1] = False
    while True:
        grown = out.copy()
        for axis in (0, 1):
            for step in (1, -1):
                moved = np.roll(out, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if step == 1 else -1
                moved[tuple(edge)] = False
                grown |= moved & void
        if (grown == out).all():
            return out
        out = grown
