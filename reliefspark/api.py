"""Whole jobs: read a raster, run one operator, encode, write."""

from __future__ import annotations

import json
import math
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scales
from .operators import prepare as P
from .operators import registry
from .operators import relational as R
from .sources import tiff, zarr
from .sources.grids import write_tiles

DTYPES = ("float32", "int16", "uint8")


def load(spark: SparkSession, path: str) -> DataFrame:
    """r, c, z of a Zarr store, of GeoTIFF files, or of Parquet pixels."""
    kind = path.rstrip("/").lower()
    if kind.endswith(".zarr"):
        return zarr.read(spark, path.rstrip("/"))
    if kind.endswith((".tif", ".tiff")):
        return tiff.read(spark, path)
    return spark.read.parquet(path).select("r", "c", "z")


def save(grid: DataFrame, path: str, overwrite: bool = False, tile: int = 512, dtype: str = "float32", pixel: tuple[float, float] = (1.0, 1.0), as_tiles: bool = False, resume: bool = False, geographic: bool = False, note: dict | None = None) -> None:
    """Write r, c, z in the format of the path's ending; Parquet tiles if it has none.

    A GeoTIFF is one cloud-optimized file, or a folder of tile files with `as_tiles`.
    """
    kind = path.rstrip("/").lower()
    if kind.endswith(".zarr"):
        zarr.write(grid, path.rstrip("/"), tile, overwrite=overwrite, dtype=dtype, note=note)
    elif kind.endswith((".tif", ".tiff")) and as_tiles:
        tiff.write(grid, path.rstrip("/"), tile, pixel, overwrite=overwrite, dtype=dtype, geographic=geographic)
    elif kind.endswith((".tif", ".tiff")):
        tiff.write_cog(grid, path.rstrip("/"), dtype, pixel, overwrite=overwrite, resume=resume, geographic=geographic, note=json.dumps(note) if note else "")
    else:
        write_tiles(grid.withColumn("z", F.col("z").cast({"float32": "float", "int16": "short", "uint8": "short"}.get(dtype, dtype))), path, tile, overwrite)


def save_bands(grid: DataFrame, path: str, overwrite: bool = False, tile: int = 512, **more) -> int:
    """Write r, c, band, z: Parquet as it is, other formats one raster a band; the number of bands."""
    from .sources.shared import kept as keep

    kept = keep(grid, "bands")  # so that the operator runs once
    bands = kept.agg(F.max("band")).first()[0] or 0
    stem, dot, ending = path.rstrip("/").rpartition(".")
    if not dot or ending.lower() not in ("zarr", "tif", "tiff"):
        write_tiles(kept, path, tile, overwrite)
        return bands
    for band in range(1, bands + 1):
        save(kept.where(F.col("band") == band).select("r", "c", "z"), f"{stem}.band{band}.{ending}", overwrite, tile, **more)
    return bands


def output_range(algorithm: str, params: dict, override: tuple[float, float] | None = None) -> tuple[float, float] | None:
    """The range that integer codes span; None where results have no fixed one."""
    if override is not None:
        if override[1] <= override[0]:
            raise ValueError("range must rise")
        return override
    unit = params.get("unit") or "degree"
    if algorithm == "slope" and unit != "degree":
        return (0.0, math.pi / 2) if unit == "radian" else None
    if params.get("st_output") == "orientation" or params.get("drift_output") in ("direction", "divergence"):
        return 0.0, 1.0
    if algorithm == "tv_decomposition" and params.get("component") == "structure":
        return None
    return scales.RANGES.get(algorithm)


def run_pipeline(
    spark: SparkSession, src: str, dst: str, algorithm: str = "topousm_fast", *, nodata: str | float | None = "none",
    output_dtype: str = "float32", override: tuple[float, float] | None = None, overwrite: bool = False, tile: int | None = None,
    pixel_size: tuple[float, float] | float | None = None, latitude: float | None = None, as_tiles: bool = False, resume: bool = False, **params,
) -> dict:
    """Read `src`, run the operator, write `dst`; says how values were encoded.

    Integer codes have 0 for NoData; value = scale * code + offset. pixel_size is one step
    or signed steps (x, y): metres, or degrees where the raster's centre latitude is given;
    without it a GeoTIFF's own pixel size counts, in degrees if it says so. Stacked bands
    are float32; rasters get one file a band (name.band1.tif and so on). Parameters that
    the operator does not know are errors. `resume` builds a GeoTIFF from the encoded tiles
    that an earlier run has left.
    """
    if output_dtype not in DTYPES:
        raise ValueError(f"output type {output_dtype!r}")
    registry._checked(algorithm, params)
    found: dict = {}
    if src.rstrip("/").lower().endswith((".tif", ".tiff")):
        found = tiff.metadata(spark, src)
    if pixel_size is not None:
        x, y = pixel_size if isinstance(pixel_size, (tuple, list)) else (pixel_size, pixel_size)
        params["pixel"] = scales.metric_pixel(x, y, latitude)
    elif latitude is not None:
        raise ValueError("a latitude needs pixel sizes in degrees")
    elif found and registry.OPERATORS[algorithm].metric:
        params["pixel"] = scales.metric_pixel(*found["pixel"], found["latitude"])
    stack = params.get("agg") == "stack"
    grid = P.without_nodata(load(spark, src), nodata)
    if nodata == "auto" and (zero := R.border_zero(grid).collect()):
        warnings.warn(f"zeros are {zero[0]['share']:.0%} of the border and count as NoData", stacklevel=2)
        grid = P.without_nodata(grid, 0.0)
    out = registry.run(grid, algorithm, tile, **params)
    span = output_range(algorithm, params, override)
    note: dict = {"algorithm": algorithm, "dtype": output_dtype}
    where = {"pixel": found.get("pixel", (1.0, 1.0)), "as_tiles": as_tiles, "resume": resume, "geographic": bool(found.get("geographic"))}
    if stack:
        bands = save_bands(out.select("r", "c", "band", F.col("value").alias("z")), dst, overwrite, tile or 512, **where)
        return note | {"dtype": "float32", "bands": bands}
    if output_dtype != "float32" and span is None:
        warnings.warn(f"{algorithm} has no fixed range: the output is float32", stacklevel=2)
    if output_dtype == "float32" or span is None:
        note["dtype"] = "float32"
        out = out.select("r", "c", F.col("value").alias("z"))
    else:
        a, b, _, _ = scales.quantizer(output_dtype, *span)
        note |= {"scale": 1 / a, "offset": -b / a, "nodata": 0, "range": list(span)}
        out = R.quantize(out, "value", output_dtype, *span).select("r", "c", F.col("code").alias("z"))
    note["parameters"] = {k: list(v) if isinstance(v, tuple) else v for k, v in params.items()}
    save(out, dst, overwrite, tile or 512, note["dtype"], note=note, **where)
    return note


def prepare_raster(spark: SparkSession, src: str, dst: str, fill: str = "enclosed", nodata: str | float | None = "auto", overwrite: bool = False, **more) -> None:
    """Fill a raster's voids and write it; `more` are the thresholds of operators.prepare."""
    found = tiff.metadata(spark, src) if src.rstrip("/").lower().endswith((".tif", ".tiff")) else {}
    save(P.prepare(load(spark, src), fill, nodata, **more), dst, overwrite, pixel=found.get("pixel", (1.0, 1.0)), geographic=bool(found.get("geographic")))
