"""Small files of a table's own, on whatever file system Spark reads."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, by name; nothing if it isn't there."""
    p, system = _path(spark, folder)
    return [x.getPath().getName() for x in system.listStatus(p)] if system.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, system = _path(spark, path)
    stream = system.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a file under another name, then give it its own, so it is there as a whole or not at all."""
    p, system = _path(spark, path)
    temp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{uuid.uuid4().hex}")
    stream = system.create(temp)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    system.delete(p, False)
    if not system.rename(temp, p):
        raise OSError(f"{path} can't be written")


def delete(spark: SparkSession, path: str) -> None:
    p, system = _path(spark, path)
    system.delete(p, True)
