"""What the operators share: tables, the shared folder, binary files, worker state."""

from __future__ import annotations

import ctypes
import gc
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words everywhere: maximal runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders that this process has made, oldest first.
MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors see.

    Only in local mode, where the executors are the driver, may a session name
    none: then a temporary folder is made and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sluice-")
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir()
    MADE.append(f"{base.rstrip('/')}/sluice-{uuid.uuid4().hex}")
    return MADE[-1]


def saved(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written to the shared folder as Parquet and read again: lineage ends there."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this package wrote, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def last_made() -> str:
    """The folder of the table that ``saved`` returned last."""
    return MADE[-1]


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete folders that this process made and that no table reads any more."""
    for path in paths:
        remove(spark, path)
        MADE.remove(path)


def clear(spark: SparkSession, since: int, *keep: str) -> None:
    """Delete the folders made since there were so many, but for those to keep."""
    for path in MADE[since:]:
        if path not in keep:
            remove(spark, path)
    MADE[since:] = [p for p in MADE[since:] if p in keep]


def file_range(spark: SparkSession, file: str, at: int, n: int) -> bytes:
    """n bytes of a file from at on, through Spark's own file systems; nothing else of it is read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(at)
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))
    finally:
        stream.close()


def write_blobs(df: DataFrame, column: str, path: str) -> None:
    """Write each row's bytes as a file of its own: the bytes, then one newline.

    Spark's text writer does the work, so any file system that Spark can write
    is a target and a lost task's files are never seen.  Within a task the
    files are numbered in row order (part-<task>-...-c<number>).
    """
    (
        df.select(F.col(column).cast("string").alias("value"))
        .write.mode("overwrite")
        .option("maxRecordsPerFile", 1)
        .text(path)
    )


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content, part, number) of each file that ``write_blobs`` made; content is read only where it is used."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    part, number = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1), F.regexp_extract("path", r"-c(\d+)(?:\.[^/-]*)?$", 1)
    return found.select("path", "length", "content", part.cast("long").alias("part"), number.cast("long").alias("number")).filter("length > 0")


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, content) of each file that ``write_blobs`` made."""
    return blobs(spark, path).select("part", "number", "content")


def worker_state() -> dict:
    """A dictionary that lives as long as a Python worker, over its tasks."""
    return sys.modules.setdefault("_sluice_worker", types.ModuleType("_sluice_worker")).__dict__


def free() -> None:
    """Give what the worker no longer uses back to the system, where that can be asked for."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidy(rows):
    """A task's function over batches that frees memory at its end, since idle workers keep theirs from stage to stage."""

    def tidied(batches):
        try:
            yield from rows(batches)
        finally:
            free()

    return tidied


def unused(df: DataFrame, name: str) -> str:
    """The name, or one made of it, that no column of df has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_text(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))
