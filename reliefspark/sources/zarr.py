"""Chunked arrays (Zarr format 2): each chunk is one file, one row and one task's work."""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Variables looked for, in this order, before the first of the store.
PREFERRED = ("elevation", "dem", "band_data", "data")
SCHEMA = "r long, c long, z double"


def _unpack(content: bytes, compressor: dict | None) -> bytes:
    kind = compressor["id"] if compressor else None
    if kind is None:
        return content
    if kind == "zlib":
        return zlib.decompress(content)
    if kind == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(content)
    raise ValueError(f"compressor {kind} is not supported")


def write(grid: DataFrame, path: str, chunk: int = 512, name: str = "result", overwrite: bool = False, dtype: str = "float64", note: dict | None = None) -> None:
    """Write a grid as a consolidated store; voids and missing chunks are NaN, or 0 in integer chunks."""
    spark = grid.sparkSession
    shared.claim(spark, path, overwrite)
    h, w = (int(x or 0) for x in grid.agg(F.max("r") + 1, F.max("c") + 1).first())
    kind, fill = {"float64": ("<f8", "NaN"), "float32": ("<f4", "NaN"), "int16": ("<i2", 0), "uint8": ("|u1", 0)}[dtype]
    meta = {"zarr_format": 2, "shape": [h, w], "chunks": [chunk, chunk], "dtype": kind, "compressor": {"id": "zstd", "level": 1}, "fill_value": fill, "order": "C", "filters": None}
    dims = {"_ARRAY_DIMENSIONS": ["y", "x"]} | (note or {})

    def work(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        i, j = (int(x) for x in key)
        z = np.full((chunk, chunk), np.nan)
        z[df.r - i * chunk, df.c - j * chunk] = df.z
        z = z if fill == "NaN" else np.nan_to_num(z, nan=0.0)
        shared.put(f"{path}/{name}/{i}.{j}", zstandard.ZstdCompressor(level=1).compress(z.astype(kind).tobytes()))
        return pd.DataFrame({"i": [i], "j": [j], "n": [len(df)]})

    at = [F.floor(F.col(x) / chunk).cast("long").alias(k) for x, k in (("r", "i"), ("c", "j"))]
    try:
        grid.select("r", "c", F.col("z").cast("double").alias("z"), *at).groupBy("i", "j").applyInPandas(work, "i long, j long, n long").agg(F.sum("n")).first()
        for at_, text in ((".zgroup", {"zarr_format": 2}), (f"{name}/.zarray", meta), (f"{name}/.zattrs", dims), (".zmetadata", {"zarr_consolidated_format": 1, "metadata": {".zgroup": {"zarr_format": 2}, f"{name}/.zarray": meta, f"{name}/.zattrs": dims}})):
            shared.write_text(spark, f"{path}/{at_}", json.dumps(text))
    except BaseException:
        shared.remove(spark, path)
        raise


def read(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """r, c, z of a store's variable (or of a bare array); fill values and NaN are NULL."""
    if shared.exists(spark, f"{path}/.zarray"):
        base = path
    else:
        known = [k[: -len("/.zarray")] for k in json.loads(shared.read_text(spark, f"{path}/.zmetadata"))["metadata"] if k.endswith("/.zarray")]
        base = f"{path}/{name or next((k for k in PREFERRED if k in known), known[0])}"
    meta = json.loads(shared.read_text(spark, f"{base}/.zarray"))
    (h, w), (ch, cw) = meta["shape"][-2:], meta["chunks"][-2:]
    fill = meta["fill_value"]
    fill = math.nan if fill is None or fill == "NaN" else float(fill)
    sep = meta.get("dimension_separator", ".")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b.path, b.content, strict=True):
                parts = file.rsplit("/", 1)[1].split(".") if sep == "." else file.split("/")
                i, j = int(parts[-2]), int(parts[-1])
                z = np.frombuffer(_unpack(content, meta["compressor"]), meta["dtype"]).reshape(ch, cw, order=meta["order"]).astype(float)
                z = z[: h - i * ch, : w - j * cw]
                r, c = np.indices(z.shape)
                yield pd.DataFrame({"r": (r + i * ch).ravel(), "c": (c + j * cw).ravel(), "z": np.where(z == fill, np.nan, z).ravel()})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    out = files.where(F.col("path").rlike(r"[0-9]+[./][0-9]+$")).select("path", "content").mapInPandas(work, SCHEMA)
    return out.withColumn("z", F.when(~F.isnan("z"), F.col("z")))
