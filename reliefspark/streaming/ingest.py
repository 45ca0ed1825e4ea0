"""Results that follow arriving pixels: each micro-batch recomputes the tiles that it touches.

Pixels come as Parquet files (r, c, z). Every batch is added to a store of tiles; where a
pixel comes again the later batch counts, and of one batch its largest value. Tiles whose
window holds a new pixel are then computed again and replace their former results, so the
results equal those of one run over all pixels so far. Operators that need statistics of
the whole grid can't follow a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import registry
from ..plans.tiles import Bounds, on_tiles
from ..sources import shared

PIXELS = "r long, c long, z double"


def _tiled(df: DataFrame, tile: int) -> DataFrame:
    return df.withColumns({"ty": F.floor(F.col("r") / tile).cast("int"), "tx": F.floor(F.col("c") / tile).cast("int")})


def latest(store: DataFrame) -> DataFrame:
    """r, c, z of the pixels as they are now."""
    return store.groupBy("r", "c").agg(F.max(F.struct("batch", "z")).alias("x")).select("r", "c", "x.z")


def _around(tiles: DataFrame, reach: int) -> DataFrame:
    """Tiles at most `reach` tiles away from the given ones."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    near = tiles.select(F.explode(F.transform(steps, lambda d: F.col("ty") + d)).alias("ty"), "tx")
    return near.select("ty", F.explode(F.transform(steps, lambda d: F.col("tx") + d)).alias("tx")).distinct()


def follow(spark: SparkSession, source: str, store: str, out: str, checkpoint: str, algorithm: str, bounds: Bounds, tile: int = 512, once: bool = True, **params) -> StreamingQuery:
    """Start a query that keeps `out` (r, c, value by tile) up to date with the files in `source`.

    With `once` it ends when all files that are there have been worked on. A batch that runs
    again after a failure writes the same rows to its own folder of the store.
    """
    function, halo = registry.tile_function(algorithm, bounds, **params)
    reach = -(-halo // tile)

    def work(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        new = _tiled(batch.select("r", "c", "z"), tile)
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").partitionBy("ty", "tx").parquet(f"{store}/batch_id={number}")
        added = session.read.parquet(f"{store}/batch_id={number}")
        touched = shared.kept(_around(added.select("ty", "tx").distinct(), reach), "touched")
        everything = session.read.option("recursiveFileLookup", "false").parquet(store)
        needed = everything.join(F.broadcast(_around(touched, reach)), ["ty", "tx"], "left_semi") if touched.count() < 100_000 else everything.join(_around(touched, reach), ["ty", "tx"], "left_semi")
        value = on_tiles(latest(needed), function, halo, tile, bounds=bounds)
        again = _tiled(value, tile).join(touched, ["ty", "tx"], "left_semi")
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ty", "tx").parquet(out)

    stream = spark.readStream.schema(PIXELS).parquet(source)
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
