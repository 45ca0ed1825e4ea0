"""Helpers that the corpus operators share: storage, Arrow batches, text rules."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: str.translate table that lower-cases A-Z and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
#: Rows in one Arrow batch; documents are long, so batches are short.
BATCH_ROWS = 512
#: Bytes in one Arrow batch, one row at least.
BATCH_BYTES = 8 << 20
#: Stands for a null doc_id inside operators, so that joins and arrays can hold it.
NO_ID = -(1 << 63)

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (spark.checkpoint.dir).

    Only where the session names none in local mode (tests) a temporary one is set; on a
    cluster executors would not see it, so its absence is an error there.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reliefspark-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            drop(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def cut(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again.

    This cuts lineage: after an executor is lost, later steps read the files again. The
    files of `done`, which cut() gave and nothing will read any more, are removed.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    for old in done:
        if at := getattr(old, "_kept_at", None):
            drop(spark, at)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def short_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, since one row may hold a very long text.

    The setting is read when a plan runs, so every operator sets the same values.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_column() -> Column:
    """doc_id as a long, NO_ID where it is null."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))


def texts_of(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id (null: NO_ID), text (null: empty) and further columns, whatever else the table has."""
    return docs.select(id_column().alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def given_ids(df: DataFrame, *names: str) -> DataFrame:
    """The rows with NO_ID turned back into null in doc_id and the named columns."""
    return df.withColumns({n: F.when(F.col(n) != NO_ID, F.col(n)) for n in ("doc_id", *names)})


def words_of(text: str) -> list[str]:
    """Lower-cased (A-Z) words of a text."""
    # bytes.lower() touches A-Z alone
    return WORD.findall(text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def held_out(modulus: int) -> Column:
    """crc32 of doc_id as text is divisible by `modulus`; from rows without an id nothing is learned."""
    own = F.col("doc_id").cast("long")
    return own.isNull() | (own == NO_ID) | (F.crc32(own.cast("string").cast("binary")) % modulus == 0)


def sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """At most `most` rows, those of the least key, a uniform 64-bit hash.

    Rows far above the cut are left out first, so that no task sends its own `most` rows on.
    """
    n = rows.count()
    if n > 4 * most:
        rows = rows.where(key < int(-(1 << 63) + 3 * most / n * (1 << 64)))
    return rows.orderBy(key, *[c for c in ("doc_id", "vec_id") if c in rows.columns]).limit(most)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema,
    )


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return first + np.arange(total)


def slices(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that a text column holds at most `most_bytes`, one row at least."""
    for b in batches:
        at, held = 0, 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()):
            if held and held + n > most_bytes:
                yield b.slice(at, i - at)
                at, held = i, 0
            held += n
        if at < b.num_rows:
            yield b.slice(at)
