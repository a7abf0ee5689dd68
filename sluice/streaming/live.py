"""Live tables: files that keep coming in, through the same operators."""

from __future__ import annotations

import json
import re
import subprocess
import threading
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import rows, store
from ..operators.rows import ARRIVAL, ORDER, SOURCE, data_columns
from ..operators.runs import SortedRuns
from ..plans.build import build
from ..plans.infer import Layout
from ..plans.spec import QuerySpec
from ..sources.text import open_table, parse
from .growing import grown, listing
from .keyed import follow_interval  # noqa: F401
from .pipes import CommandSource, LineLog, Recorder  # noqa: F401


def follow(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Lines of files as they appear in a folder; all lines of a batch share their arrival time.

    Files should be moved in whole, as ``Feeder`` does with what it reads from a pipe.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_a_batch).load(folder)
    place = F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    return lines.select(F.col("value").alias("_raw"), place.alias("_place"), F.current_timestamp().alias(ARRIVAL), F.col("_metadata.file_name").alias(SOURCE))


class Feeder(Recorder):
    """Puts what comes through a pipe into a followed folder, whole lines in whole files.

    Files are numbered on from those that are there, and stay; the segments of a
    ``LineLog`` and its stream (``pipes.follow_log``) go once they were read.
    """

    def __init__(self, folder: str, idle: float = 0.02, hold: float = 0.2, most: int = 1 << 20):
        super().__init__(LineLog(folder), idle, hold, most)
        found = [re.fullmatch(r"part-(\d+)\.txt", x.rpartition("/")[2]) for x in listing(self.log.folder)]
        self.files = max((int(m[1]) + 1 for m in found if m), default=0)

    def seal(self, data: bytes) -> None:
        if data:
            self.log.put(data, f"part-{self.files:09d}.txt")
            self.files += 1

    def run(self, stream) -> int:
        """Read a stream to its end; returns the files there are then."""
        super().run(stream)
        return self.files


def feed_command(command: str, folder: str, allow: bool = False) -> tuple[subprocess.Popen, threading.Thread]:
    """A shell command whose output is fed to a folder while it runs; only with allow, since it runs on the driver."""
    if not allow:
        raise PermissionError("commands run only with allow=True")
    process = subprocess.Popen(["sh", "-c", command], stdout=subprocess.PIPE)
    return process, Feeder(folder).start(process.stdout)


class Pace(StreamingQueryListener):
    """Adapts how many bytes a batch of a growing source takes to what waits and how long batches take.

    A batch that was full is followed by one twice as large, as long as batches end
    within target seconds; one that took longer, or was far from full, by one half as
    large.  The size goes to the source through the file that its option pace names.
    """

    def __init__(self, spark: SparkSession, path: str, target: float = 5.0, least: int = 1 << 16, most: int = 1 << 30, start: int | None = None):
        self.spark, self.path, self.target, self.least, self.most = spark, path, target, least, most
        self.sizes = [start or least]
        self.set(self.sizes[0])

    def set(self, size: int) -> None:
        store.write_text(self.spark, self.path, str(size))

    def next_size(self, size: int, taken: int, seconds: float) -> int:
        if seconds > self.target or taken < size // 4:
            return max(self.least, size // 2)
        return min(self.most, 2 * size) if taken >= size // 2 else size

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        taken = sum(grown_bytes(s.startOffset, s.endOffset) for s in progress.sources)
        size = self.next_size(self.sizes[-1], taken, progress.batchDuration / 1000)
        if size != self.sizes[-1]:
            self.sizes.append(size)
            self.set(size)

    def onQueryIdle(self, event) -> None:
        size = max(self.least, self.sizes[-1] // 2)
        if size != self.sizes[-1]:
            self.sizes.append(size)
            self.set(size)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def grown_bytes(start: str | None, end: str | None) -> int:
    """Bytes between two offsets of a growing source, as a query's progress shows them; 0 of other sources."""

    def files(offset: str | None) -> dict:
        found = json.loads(offset or "{}")
        return json.loads(found.get("files", "{}")) if isinstance(found, dict) else {}

    return sum(high - low for _, low, high in grown(files(start), files(end)))


def pressure(query: StreamingQuery) -> float:
    """Rows that come in for each row that is processed, by the last batch; above 1 the query falls behind."""
    last = query.lastProgress
    coming, done = (float(last[k] or 0) if last else 0.0 for k in ("inputRowsPerSecond", "processedRowsPerSecond"))
    return coming / done if done else 0.0


def table(lines: DataFrame, layout: Layout, header: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, excluded lines) of a stream; the layout stays as it was when the stream began."""
    kept = lines.filter("_raw != ''")
    if header is not None:
        kept = kept.filter(F.col("_raw") != header)
    parsed = parse(kept, layout)
    return parsed.filter("_ok").drop("_ok", "_raw"), parsed.filter("not _ok").select("_raw")


class Skips:
    """How many lines didn't fit, and the first of them."""

    def __init__(self, keep: int = 200):
        self.keep, self.rows, self.skipped = keep, 0, 0
        self.samples: list[str] = []

    def add(self, parsed: DataFrame, number: int) -> DataFrame:
        """The rows of a parsed batch that fit; the others are counted as the batch is read."""
        seen = Observation(f"skips_{uuid.uuid4().hex}")
        parsed = parsed.observe(seen, F.count("*").alias("rows"), F.count_if(~F.col("_ok")).alias("bad"))
        self.waiting = seen, parsed
        return parsed.filter("_ok").drop("_ok", "_raw")

    def settle(self) -> None:
        """After the batch was read: take its counts, and samples as long as there is room."""
        seen, parsed = self.waiting
        found = seen.get
        self.rows += found["rows"]
        self.skipped += found["bad"]
        if found["bad"] and len(self.samples) < self.keep:
            self.samples += [r["_raw"] for r in parsed.filter("not _ok").select("_raw").limit(self.keep - len(self.samples)).collect()]


def accounted(lines: DataFrame, layout: Layout, header: str | None, folder: str, checkpoint: str, skips: Skips, **trigger) -> StreamingQuery:
    """Rows that fit are added to a folder of Parquet files; skips counts the others and keeps the first of them."""
    kept = lines.filter("_raw != ''")
    if header is not None:
        kept = kept.filter(F.col("_raw") != header)

    def batch(new: DataFrame, number: int) -> None:
        good = skips.add(parse(new, layout), number)
        good.withColumn("_batch_id", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")
        skips.settle()

    return kept.drop("_place").writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


class Split:
    """One stream of lines as two tables: rows that fit a layout, and lines that don't.

    Both are written from one reading of each batch, by one job; a batch counts in
    either table once that job is committed, so shown and excluded lines together are
    those of the source up to the same batch.
    """

    def __init__(self, spark: SparkSession, folder: str, layout: Layout):
        self.spark, self.folder, self.layout = spark, folder.rstrip("/"), layout

    def start(self, lines: DataFrame, checkpoint: str, header: str | None = None, **trigger) -> StreamingQuery:
        kept = lines.filter("_raw != ''")
        if header is not None:
            kept = kept.filter(F.col("_raw") != header)

        def batch(new: DataFrame, number: int) -> None:
            ordered = new.withColumn(ORDER, F.monotonically_increasing_id() + F.lit(number) * F.lit(1 << 40)).drop("_place")
            parse(ordered, self.layout).write.partitionBy("_ok").mode("overwrite").parquet(f"{self.folder}/batch={number}")

        return kept.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()

    def batches(self) -> list[int]:
        """The batches whose job was committed."""
        found = [x for x in store.names(self.spark, self.folder) if x.startswith("batch=")]
        return sorted(int(x[6:]) for x in found if "_SUCCESS" in store.names(self.spark, f"{self.folder}/{x}"))

    def table(self, ok: bool) -> DataFrame:
        names = [*self.layout.names, ORDER, ARRIVAL, SOURCE, "_raw"]
        kinds = ", ".join(f"`{n}` {({ORDER: 'long', ARRIVAL: 'timestamp'}).get(n, 'string')}" for n in names)
        paths = [f"{self.folder}/batch={k}" for k in self.batches()]
        reader = self.spark.read.schema(f"{kinds}, _ok boolean")
        found = reduce(DataFrame.unionByName, [reader.parquet(p) for p in paths]) if paths else self.spark.createDataFrame([], f"{kinds}, _ok boolean")
        return found.filter(F.col("_ok") == ok).drop("_ok")

    def shown(self) -> DataFrame:
        return self.table(True).drop("_raw")

    def excluded(self) -> DataFrame:
        return self.table(False).select("_raw", ORDER, ARRIVAL, SOURCE)

    def reopened(self, delimiter: str | None = None) -> tuple[DataFrame, Layout]:
        """The excluded lines as a table of their own; its layout is inferred from those that there are by now."""
        return open_table(self.excluded(), delimiter)


def kept_sorted(df: DataFrame, runs: SortedRuns, checkpoint: str, **trigger) -> StreamingQuery:
    """A stream's rows as a sorted table: each batch is a run, and only runs of its size are read again (``SortedRuns``)."""

    def batch(new: DataFrame, number: int) -> None:
        placed = new.withColumn(ORDER, F.monotonically_increasing_id() + F.lit(number) * F.lit(1 << 40)).drop("_place")
        runs.add(placed, number)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


class Window:
    """The changes of a rolling window (``keyed.rolling``), batch by batch, and what is inside by now."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str]):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def start(self, changes: DataFrame, checkpoint: str, every: float) -> StreamingQuery:
        self.columns = [c for c in changes.columns if c != "op"]

        def batch(new: DataFrame, number: int) -> None:
            new.write.mode("overwrite").parquet(f"{self.folder}/{number:012d}")
            if number and number % MERGE == 0:
                self.merge(number)

        writer = changes.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", checkpoint)
        return writer.trigger(processingTime=f"{every} seconds").start()

    def parts(self) -> list[str]:
        """The newest table of merged batches and the batches behind it, those that are whole."""
        found = sorted(x for x in store.names(self.spark, self.folder) if "_SUCCESS" in store.names(self.spark, f"{self.folder}/{x}"))
        merged = [x for x in found if x.endswith("m")]
        return [*merged[-1:], *(x for x in found if not x.endswith("m") and (not merged or x > merged[-1][:-1]))]

    def merge(self, number: int) -> None:
        """What is inside after a batch, as one table; tables it stands for go once the next one is written."""
        parts = self.parts()
        self.inside(parts).withColumn("op", F.lit(1)).coalesce(8).write.mode("overwrite").parquet(f"{self.folder}/{number:012d}m")
        for x in store.names(self.spark, self.folder):
            if x[:12] < parts[0][:12]:
                store.delete(self.spark, f"{self.folder}/{x}")

    def inside(self, parts: list[str]) -> DataFrame:
        """Rows that came in and haven't left."""
        log = self.spark.read.parquet(*[f"{self.folder}/{x}" for x in parts])
        rest = [c for c in log.columns if c not in ("op", *self.key)]
        left = log.groupBy(*self.key).agg(F.sum("op").alias("op"), *[F.first(c).alias(c) for c in rest]).filter("op > 0")
        return left.select(*[c for c in log.columns if c != "op"])

    def view(self) -> DataFrame:
        return self.inside(self.parts())


def appended(df: DataFrame, spec: QuerySpec, name: str, checkpoint: str, path: str | None = None, **trigger) -> StreamingQuery:
    """Filters and computed columns only: rows are added as they come, into a table in memory, or to Parquet files at path."""
    from ..operators.columns import add_computed

    out = rows.filter_rows(add_computed(df, spec.computed), spec.filters, spec.strict)
    writer = out.writeStream.outputMode("append").queryName(name).option("checkpointLocation", checkpoint)
    writer = writer.format("parquet").option("path", path) if path else writer.format("memory")
    return writer.trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def live_pivot(df: DataFrame, keys: list[str], place: str | None = None) -> DataFrame:
    """Counts per key, largest first, for complete mode.  State holds every key for good.

    place: a column by which rows came; with it the other cells of each key's last row are there as well.
    """
    names = [f"`{k}`" for k in keys]
    rest = [c for c in data_columns(df) if c not in keys and c != place] if place else []
    last = [F.max_by(F.struct(*[f"`{c}`" for c in rest]), F.col(place)).alias("_last")] if rest else []
    counts = df.groupBy(*names).agg(F.count("*").alias("count"), *last)
    return counts.select("count", *names, *[F.col(f"_last.`{c}`").alias(c) for c in rest]).orderBy(F.desc("count"), *names)


def start_pivot(df: DataFrame, keys: list[str], name: str, checkpoint: str, place: str | None = None, **trigger) -> StreamingQuery:
    writer = live_pivot(df, keys, place).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "0 seconds"})).start()


#: Batches whose rows are put together.
MERGE = 32


def recomputed(df: DataFrame, spec: QuerySpec, folder: str, checkpoint: str, show: Callable[[DataFrame, int], None], every: str = "1 second", **trigger) -> StreamingQuery:
    """Sorts, windows and dedup: rows are kept in a folder and the query is evaluated anew over them after each batch.

    _batch_id says in which batch a row came, and a batch that is written again
    after a failure takes its own place.  Rows of MERGE batches are put into few
    larger files, so that a long stream is not read from a file for each batch.
    """

    def batch(new: DataFrame, number: int) -> None:
        path = f"{folder}/_batch_id={number}"
        new.withColumn(ORDER, F.monotonically_increasing_id() + F.lit(number) * F.lit(1 << 40)).drop("_place").write.mode("overwrite").parquet(path)
        merged = number // MERGE
        if number % MERGE == 0 and number:
            # the batches before this one, as one; a run that breaks off here does it again
            spark = new.sparkSession
            before = spark.read.option("basePath", folder).parquet(*[f"{folder}/_batch_id={k}" for k in range(number - MERGE, number)])
            before.repartition(8, ORDER).write.mode("overwrite").parquet(f"{folder}/_merged/{merged - 1}")
        parts = [new.sparkSession.read.option("basePath", folder).parquet(*[f"{folder}/_batch_id={k}" for k in range(merged * MERGE, number + 1)])]
        if merged:
            parts.append(new.sparkSession.read.parquet(*[f"{folder}/_merged/{k}" for k in range(merged)]))
        show(build(spec, reduce(DataFrame.unionByName, parts))[0], number)

    return df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": every})).start()


def needs_recompute(spec: QuerySpec) -> bool:
    """Whether a query must see all rows again when new ones come."""
    return bool(spec.sort or spec.unique or spec.pivot or spec.window)
