"""GeoTIFF: one cloud-optimized file, or a folder of tile files that tasks write.

Files are tiled, zstd-compressed and predicted (horizontally for integers, by floating
point for float32), with overviews of valid means and the directories before the data.
Tiles are encoded by tasks; one task then streams the encoded tiles into the file, so it
never holds more than a batch of them. The reader takes strips or tiles, no, LZW,
deflate or zstd compression and both predictors; of several bands it takes the first. Tie
point and pixel scale place a file on the grid. Tiles of one file are read by ranges, in
many tasks, so its size has no bound; a file's directory is read on the driver.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tiles import bounds_of
from . import shared

# Tags and field types of the format.
SUBFILE, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_SIZE, PLANAR = 254, 256, 257, 258, 259, 262, 270, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_SIZE, SAMPLE_FORMAT, PIXEL_SCALE, TIE_POINT, GEO_KEYS, NODATA = 317, 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
SCHEMA = "r long, c long, z double"
BLOCK = 512
#: Overview levels, at most: 2, 4, ... 256.
LEVELS = tuple(2**k for k in range(1, 9))
DTYPES = {"float32": ("<f4", 3, 3, b"nan\0"), "int16": ("<i2", 2, 2, b"0\0"), "uint8": ("|u1", 1, 2, b"0\0"), "float64": ("<f8", 3, 1, b"nan\0")}


def _packed(z: np.ndarray, dtype: str, block: int) -> bytes:
    """One block: voids as NoData, padded, predicted and compressed."""
    kind, _, predictor, _ = DTYPES[dtype]
    x = np.full((block, block), np.nan)
    x[: z.shape[0], : z.shape[1]] = z
    if dtype not in ("float32", "float64"):
        x = np.nan_to_num(x, nan=0.0)
    x = x.astype(kind)
    if predictor == 3:
        size = x.dtype.itemsize
        planes = np.ascontiguousarray(x.astype(x.dtype.newbyteorder(">"))).view(np.uint8).reshape(block, block, size).transpose(0, 2, 1).reshape(block, -1)
        x = np.diff(planes, axis=1, prepend=np.uint8(0))
    elif predictor == 2:
        x = np.diff(x, axis=1, prepend=x.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _header(levels: list[tuple[int, int, list[int]]], r0: int, c0: int, pixel: tuple[float, float], dtype: str, block: int, geographic: bool, note: str = "") -> tuple[bytes, list[int]]:
    """Directories of all levels (height, width, sizes of blocks), and where each level's data begin: smallest level first."""
    kind, form, predictor, nodata = DTYPES[dtype]

    def directories(starts: list[int]) -> bytes:
        out, at = b"", 16
        for i, (h, w, sizes) in enumerate(levels):
            places = (starts[i] + np.concatenate([[0], np.cumsum(sizes)[:-1]])).astype("<u8") if len(sizes) else np.zeros(0, "<u8")
            fields = [(SUBFILE, 4, (int(i > 0),)), (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (np.dtype(kind).itemsize * 8,)), (COMPRESSION, 3, (50000,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)), (PLANAR, 3, (1,)), (PREDICTOR, 3, (predictor,)), (TILE_WIDTH, 3, (block,)), (TILE_HEIGHT, 3, (block,)), (TILE_AT, 16, places), (TILE_SIZE, 16, np.array(sizes, "<u8")), (SAMPLE_FORMAT, 3, (form,))]
            if i == 0:
                fields += [(PIXEL_SCALE, 12, (abs(pixel[0]), abs(pixel[1]), 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, c0 * abs(pixel[0]), -r0 * abs(pixel[1]), 0.0)), (GEO_KEYS, 3, (1, 1, 0, 1, 1024, 0, 1, 2 if geographic else 1))]
                if note:
                    fields.insert(6, (DESCRIPTION, 2, note.encode() + b"\0"))
            fields.append((NODATA, 2, nodata))
            extra, entries = b"", b""
            after = at + 8 + 20 * len(fields) + 8
            for tag, code, values in fields:
                raw = values if code == 2 else values.tobytes() if isinstance(values, np.ndarray) else struct.pack(f"<{len(values)}{TYPES[code]}", *values)
                place = raw.ljust(8, b"\0")
                if len(raw) > 8:
                    place = struct.pack("<Q", after + len(extra))
                    extra += raw + b"\0" * (-len(raw) % 8)
                entries += struct.pack("<HHQ", tag, code, len(values)) + place
            end = after + len(extra)
            out += struct.pack("<Q", len(fields)) + entries + struct.pack("<Q", end if i + 1 < len(levels) else 0) + extra
            at = end
        return struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + out

    starts, at = [0] * len(levels), len(directories([0] * len(levels)))
    for i in reversed(range(len(levels))):
        starts[i] = at
        at += sum(levels[i][2])
    return directories(starts), starts


def _means(z: np.ndarray, f: int) -> np.ndarray:
    """Means of the valid cells of f x f blocks."""
    h, w = (-(-n // f) for n in z.shape)
    p = np.pad(z, ((0, h * f - z.shape[0]), (0, w * f - z.shape[1])), constant_values=np.nan).reshape(h, f, w, f)
    n = np.isfinite(p).sum((1, 3))
    return np.where(n > 0, np.nansum(p, (1, 3)) / np.maximum(n, 1), np.nan)


def encode(z: np.ndarray, r0: int, c0: int, pixel: float | tuple[float, float] = 1.0, dtype: str = "float64", block: int = 256, geographic: bool = False) -> bytes:
    """A whole small raster as one file, with overviews while they are larger than a block."""
    grids = [z]
    for level in LEVELS:
        if max(z.shape) / level < block:
            break
        grids.append(_means(z, level))
    levels, data = [], []
    for g in grids:
        if dtype in ("int16", "uint8"):
            g = np.rint(g)
        parts = [_packed(g[y : y + block, x : x + block], dtype, block) for y in range(0, g.shape[0], block) for x in range(0, g.shape[1], block)]
        levels.append((*g.shape, [len(p) for p in parts]))
        data.append(b"".join(parts))
    pixel = pixel if isinstance(pixel, tuple) else (pixel, pixel)
    return _header(levels, r0, c0, pixel, dtype, block, geographic)[0] + b"".join(reversed(data))


def _fields(data: bytes, at: int | None = None) -> tuple[str, dict, int]:
    """Byte order, fields of a directory (the first, or the one at a place) and the place of the next."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] not in (42, 43):
        raise ValueError("not a TIFF file")
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    offset, count, number, step = ("Q", "Q", "Q", 20) if big else ("I", "H", "I", 12)
    at = struct.unpack_from(order + offset, data, 8 if big else 4)[0] if at is None else at
    n = struct.unpack_from(order + count, data, at)[0]
    at += struct.calcsize(order + count)
    out = {}
    for i in range(n):
        tag, kind = struct.unpack_from(order + "HH", data, at + i * step)
        size = struct.unpack_from(order + number, data, at + i * step + 4)[0]
        if kind not in TYPES:
            continue
        form = f"{order}{size}{TYPES[kind]}"
        place = at + i * step + (12 if big else 8)
        if struct.calcsize(form) > (8 if big else 4):
            place = struct.unpack_from(order + offset, data, place)[0]
        out[tag] = struct.unpack_from(form, data, place)
    return order, out, struct.unpack_from(order + offset, data, at + n * step)[0]


def _lzw(data: bytes) -> bytes:
    """Decompress: codes of 9 to 12 bits, upper bit first, one code early."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFFF, bits + 8
        if bits < width:
            continue
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        entry = table[code] if code < len(table) else last + last[:1]
        out += entry
        if last is not None:
            table.append(last + entry[:1])
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
        last = entry
    return bytes(out)


def _plain(data: bytes, kind: int) -> bytes:
    if kind == 1:
        return data
    if kind == 5:
        return _lzw(data)
    if kind in (8, 32946):
        return zlib.decompress(data)
    if kind == 50000:
        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"compression {kind} is not supported")


class Layout:
    """What a file's first directory says of its blocks."""

    def __init__(self, order: str, f: dict):
        self.w, self.h = f[WIDTH][0], f[HEIGHT][0]
        self.bands = f.get(SAMPLES, (1,))[0] if f.get(PLANAR, (1,))[0] == 1 else 1
        self.size = f[BITS][0] // 8
        self.dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[f.get(SAMPLE_FORMAT, (1,))[0]] }{self.size}")
        self.tiled = TILE_AT in f
        self.bw, self.bh = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if self.tiled else (self.w, min(f.get(ROWS_PER_STRIP, (self.h,))[0], self.h))
        self.places, self.sizes = (f[TILE_AT], f[TILE_SIZE]) if self.tiled else (f[STRIP_AT], f[STRIP_SIZE])
        self.across = -(-self.w // self.bw)
        self.blocks = self.across * -(-self.h // self.bh)
        self.predictor, self.compression = f.get(PREDICTOR, (1,))[0], f.get(COMPRESSION, (1,))[0]
        self.nodata = f[NODATA][0].split(b"\0")[0].decode().strip() if NODATA in f else ""
        self.pixel = tuple(f[PIXEL_SCALE][:2]) if PIXEL_SCALE in f else None
        keys = f.get(GEO_KEYS, ())
        self.geographic = any(keys[i] == 1024 and keys[i + 3] == 2 for i in range(4, len(keys) - 3, 4))
        self.r0 = self.c0 = 0
        self.y0 = 0.0
        if self.pixel and TIE_POINT in f:
            i, j, _, px, py = f[TIE_POINT][:5]
            self.r0, self.c0, self.y0 = round(-py / self.pixel[1] - j), round(px / self.pixel[0] - i), py

    def block(self, k: int, raw: bytes) -> tuple[np.ndarray, int, int]:
        """Values of a block (voids NaN) and its first row and column in the file."""
        y, x = k // self.across * self.bh, k % self.across * self.bw
        rows = self.bh if self.tiled else min(self.bh, self.h - y)
        raw = _plain(raw, self.compression)
        if self.predictor == 3:
            planes = np.frombuffer(raw, np.uint8).reshape(rows, -1, self.bands).cumsum(1, dtype=np.uint8).reshape(rows, self.size, self.bw * self.bands)
            block = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{self.size}").reshape(rows, self.bw, self.bands)
        else:
            block = np.frombuffer(raw, self.dtype, rows * self.bw * self.bands).reshape(rows, self.bw, self.bands)
            if self.predictor == 2:
                block = block.cumsum(1, dtype=self.dtype.newbyteorder("="))
        z = block[: self.h - y, : self.w - x, 0].astype(float)
        if self.nodata and self.nodata.lower() != "nan":
            z[np.isclose(z, float(self.nodata), rtol=1e-6, atol=0)] = np.nan
        z[~np.isfinite(z)] = np.nan
        return z, y, x


def decode(data: bytes) -> tuple[np.ndarray, int, int, str]:
    """First band (voids NaN), its row and column on the grid, and the NoData text."""
    order, f, _ = _fields(data)
    at = Layout(order, f)
    z = np.full((at.h, at.w), np.nan)
    for k in range(at.blocks):
        if at.sizes[k]:
            block, y, x = at.block(k, data[at.places[k] : at.places[k] + at.sizes[k]])
            z[y : y + block.shape[0], x : x + block.shape[1]] = block
    return z, at.r0, at.c0, at.nodata


def write(grid: DataFrame, path: str, tile: int = 512, pixel: float | tuple[float, float] = 1.0, overwrite: bool = False, dtype: str = "float64", geographic: bool = False) -> None:
    """Write a grid as a folder with one file for each tile of its raster; pixels that have no row are voids."""
    spark = grid.sparkSession
    shared.claim(spark, path, overwrite)
    bounds = bounds_of(grid)
    if bounds is None:
        return

    def work(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        i, j = (int(k) for k in key)
        r0, c0 = max(bounds.r0, i * tile), max(bounds.c0, j * tile)
        z = np.full((min(bounds.r1, (i + 1) * tile - 1) - r0 + 1, min(bounds.c1, (j + 1) * tile - 1) - c0 + 1), np.nan)
        df = df[df.here]
        z[df.r - r0, df.c - c0] = df.z
        shared.put(f"{path}/tile_{i}_{j}.tif", encode(z, r0, c0, pixel, dtype, geographic=geographic))
        return pd.DataFrame({"n": [len(df)]})

    at = [F.floor(F.col(x) / tile).cast("long").alias(k) for x, k in (("r", "i"), ("c", "j"))]
    # a row for each tile, so that tiles without pixels get their file too
    (i0, i1), (j0, j1) = ((first // tile, last // tile) for first, last in ((bounds.r0, bounds.r1), (bounds.c0, bounds.c1)))
    k, n = F.col("id"), j1 - j0 + 1
    every = spark.range((i1 - i0 + 1) * n).select(F.lit(bounds.r0).cast("long").alias("r"), F.lit(bounds.c0).cast("long").alias("c"), F.lit(None).cast("double").alias("z"), (F.floor(k / n) + i0).cast("long").alias("i"), (k % n + j0).cast("long").alias("j"), F.lit(False).alias("here"))
    try:
        grid.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("z").cast("double").alias("z"), *at, F.lit(True).alias("here")).unionByName(every).groupBy("i", "j").applyInPandas(work, "n long").agg(F.sum("n")).first()
    except BaseException:
        shared.remove(spark, path)
        raise


def encoded_tiles(grid: DataFrame, r0: int, c0: int, dtype: str, block: int, levels: list[int]) -> DataFrame:
    """level, ty, tx and data of every block of the raster and of its overviews."""

    def work(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        level, ty, tx = (int(k) for k in key)
        z = np.full((block, block), np.nan)
        z[df.r - ty * block, df.c - tx * block] = df.z
        return pd.DataFrame({"level": [level], "ty": [ty], "tx": [tx], "data": [_packed(z, dtype, block)]})

    base = grid.select((F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c"), F.col("z").cast("double").alias("z"))
    if dtype in ("int16", "uint8"):
        base = base.withColumn("z", F.when(F.col("z") != 0, F.col("z")))
    at = base.select("r", "c", F.coalesce("z", F.lit(0.0)).alias("s"), F.col("z").isNotNull().cast("long").alias("n"))
    every = base.select(F.lit(1).alias("level"), "r", "c", "z")
    for level in levels:  # each overview is made from the one before it
        at = at.groupBy(F.floor(F.col("r") / 2).cast("long").alias("r"), F.floor(F.col("c") / 2).cast("long").alias("c")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        mean = F.when(F.col("n") > 0, F.col("s") / F.col("n"))
        every = every.unionByName(at.select(F.lit(level).alias("level"), "r", "c", (F.rint(mean) if dtype in ("int16", "uint8") else mean).alias("z")))
    dealt = every.withColumns({"ty": F.floor(F.col("r") / block).cast("long"), "tx": F.floor(F.col("c") / block).cast("long")})
    return dealt.groupBy("level", "ty", "tx").applyInPandas(work, "level int, ty long, tx long, data binary")


def write_cog(grid: DataFrame, path: str, dtype: str = "float32", pixel: float | tuple[float, float] = 1.0, block: int = BLOCK, overwrite: bool = False, geographic: bool = False, resume: bool = False, note: str = "") -> None:
    """Write a grid as one cloud-optimized file.

    Encoded tiles are kept beside the file until it is complete; with `resume` those that an
    earlier call left are used again and the grid is not computed.
    """
    spark = grid.sparkSession
    shared.claim(spark, path, overwrite)
    bounds = bounds_of(grid)
    if bounds is None:
        raise ValueError("no pixels to write")
    (h, w), parts = bounds.shape, f"{path}.parts"
    levels = [k for k in LEVELS if max(h, w) * 2 / k > block and k <= min(h, w)]
    if not (resume and shared.exists(spark, f"{parts}/_SUCCESS")):
        encoded_tiles(grid, bounds.r0, bounds.c0, dtype, block, levels).write.mode("overwrite").parquet(parts)
    tiles = spark.read.parquet(parts)
    sizes = {(r["level"], r["ty"], r["tx"]): r["size"] for r in tiles.select("level", "ty", "tx", F.length("data").alias("size")).collect()}  # three numbers for each block
    shapes = [(1, h, w), *((k, -(-h // k), -(-w // k)) for k in levels)]
    plan = [(b_h, b_w, [sizes.get((k, y, x), 0) for y in range(-(-b_h // block)) for x in range(-(-b_w // block))]) for k, b_h, b_w in shapes]
    header, _ = _header(plan, bounds.r0, bounds.c0, pixel if isinstance(pixel, tuple) else (pixel, pixel), dtype, block, geographic, note)

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with shared.writing(path) as out:
            out.write(header)
            for b in batches:
                for data in b.column("data"):
                    out.write(data.as_buffer())
        yield pa.RecordBatch.from_pydict({"done": [True]})

    ordered = tiles.repartition(1).sortWithinPartitions(F.desc("level"), "ty", "tx").select("data")
    try:
        ordered.mapInArrow(stream, "done boolean").collect()
    except BaseException:
        shared.remove(spark, path)
        raise
    shared.remove(spark, parts)


def validate(path: str) -> dict:
    """What a viewer wants of a file: tiles, overviews, directories before data, sensible blocks; `passed` from 60 points up."""
    head = shared.head(path, 16 << 20)
    order, f, place = _fields(head)
    first, overviews, last = Layout(order, f), 0, 0
    while place:
        last = max(last, place)
        _, g, place = _fields(head, place)
        overviews += g.get(SUBFILE, (0,))[0] & 1
    ahead = all(last < p for p, n in zip(first.places, first.sizes, strict=True) if n)
    optimized = first.tiled and ahead
    score = 30 * first.tiled + min(40, 10 * overviews) + 20 * optimized + 10 * (512 <= first.bw <= 1024)
    return {"tiled": first.tiled, "overviews": overviews, "optimized": optimized, "block": first.bw, "score": score, "passed": optimized and score >= 60}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.tif*").load(path)


def metadata(spark: SparkSession, path: str) -> dict:
    """Pixel size, whether it is in degrees, and the centre's latitude then; of a folder its first file tells."""
    if shared.is_folder(spark, path):
        found = _files(spark, path).select("content").limit(1).collect()
        head = bytes(found[0]["content"]) if found else b""
    else:
        head = shared.head(path, 16 << 20)
    if not head:
        return {}
    order, f, _ = _fields(head)
    at = Layout(order, f)
    if at.pixel is None:
        return {}
    said = f[DESCRIPTION][0].split(b"\0")[0].decode() if DESCRIPTION in f else ""
    return {"note": said, "pixel": (at.pixel[0], -at.pixel[1]), "geographic": at.geographic, "latitude": at.y0 - at.h / 2 * at.pixel[1] if at.geographic else None}


def _read_one(spark: SparkSession, path: str) -> DataFrame:
    """One file by the ranges of its blocks."""
    order, f, _ = _fields(shared.head(path, 16 << 20))
    at = Layout(order, f)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with shared.reading(path) as file:
            for b in batches:
                for k, place, size in zip(b.k, b.place, b["size"], strict=True):
                    z, y, x = at.block(int(k), bytes(file.read_at(int(size), int(place))))
                    r, c = np.indices(z.shape)
                    yield pd.DataFrame({"r": (r + y + at.r0).ravel(), "c": (c + x + at.c0).ravel(), "z": z.ravel()})

    ranges = spark.createDataFrame([(k, int(p), int(n)) for k, (p, n) in enumerate(zip(at.places, at.sizes, strict=True)) if n], "k int, place long, size long")
    out = ranges.repartition(max(1, min(at.blocks, 4 * spark.sparkContext.defaultParallelism))).mapInPandas(work, SCHEMA)
    return out.withColumn("z", F.when(~F.isnan("z"), F.col("z")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One file, or the mosaic of a folder, whose files must agree in their NoData."""
    if not shared.is_folder(spark, path):
        return _read_one(spark, path)

    def marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"nodata": [(_fields(x)[1].get(NODATA) or (b"",))[0].split(b"\0")[0].decode().strip() for x in b.content]})

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for content in b.content:
                z, r0, c0, _ = decode(content)
                r, c = np.indices(z.shape)
                yield pd.DataFrame({"r": (r + r0).ravel(), "c": (c + c0).ravel(), "z": z.ravel()})

    files = _files(spark, path).select("content")
    if files.mapInPandas(marks, "nodata string").agg(F.count_distinct("nodata").alias("n")).first()["n"] > 1:
        raise ValueError("files differ in their NoData")
    return files.mapInPandas(work, SCHEMA).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
