"""The shared folder, and small files on any file system that Spark reads."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_paths: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder of spark.checkpoint.dir, removed when the driver's process ends.

    A local folder is used where none is set, in local mode only: on a cluster executors
    would not see it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reliefspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _paths:
        atexit.register(_clean)
    _paths.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _paths:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended first
            return


def kept(df: DataFrame, name: str) -> DataFrame:
    """A DataFrame written to the shared folder and read again, so that it is computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _at(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    target, system = _at(spark, path)
    system.delete(target, True)


def read_text(spark: SparkSession, path: str) -> str:
    target, system = _at(spark, path)
    stream = system.open(target)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    target, system = _at(spark, path)
    stream = system.create(target, True)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()


def claim(spark: SparkSession, path: str, overwrite: bool) -> None:
    """Refuse an output that exists, or remove it."""
    if exists(spark, path):
        if not overwrite:
            raise FileExistsError(f"{path} exists")
        remove(spark, path)


def put(path: str, content: bytes) -> None:
    """Write a file from a task; a task that runs again replaces the file as a whole."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.part-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(content)
    system.move(part, at)


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@contextlib.contextmanager
def writing(path: str):
    """A stream into a file that appears as a whole when it is done; for tasks."""
    system, at = _system(path)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    part = f"{at}.part-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, at)


def reading(path: str):
    """A file that is read by ranges."""
    system, at = _system(path)
    return system.open_input_file(at)


def head(path: str, most: int) -> bytes:
    """A file's first bytes."""
    with reading(path) as file:
        return file.read(most)


def is_folder(spark: SparkSession, path: str) -> bool:
    target, system = _at(spark, path)
    return system.getFileStatus(target).isDirectory()
