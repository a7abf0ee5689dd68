"""Pipes and commands as replayable streams.

What comes through a pipe can't be asked for again, so it is recorded: whole lines are
sealed into numbered segments of a log in a shared folder, each written under another
name and then moved, so a segment is there as a whole or not at all.  A stream's offset
is the number of a segment.  A query that was killed reads the segments again that it
hadn't committed; those before are deleted on commit, but for the newest, whose name
says how many lines were sealed so far.
"""

from __future__ import annotations

import re
import select
import subprocess
import sys
import threading
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators.rows import ARRIVAL, SOURCE
from .growing import store

# the sources' classes go to executors by value, so these need no package of their own
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = re.compile(r"(\d{12})-(\d+)\.txt$")


class LineLog:
    """Numbered segments of whole lines in a folder that all executors see."""

    def __init__(self, folder: str):
        self.system, self.folder = store(folder)
        self.system.create_dir(self.folder)

    def segments(self) -> dict[int, tuple[str, int]]:
        """(path, lines sealed up to its end) by number."""
        from pyarrow import fs

        found = self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return {int(m[1]): (x.path, int(m[2])) for x in found if (m := NAME.match(x.base_name))}

    def last(self) -> tuple[int, int]:
        """(number of the newest segment, lines up to its end); 0 and 0 before the first."""
        found = self.segments()
        return (n := max(found), found[n][1]) if found else (0, 0)

    def seal(self, data: bytes) -> int:
        """Write a segment of whole lines; returns its number."""
        number, lines = self.last()
        self.put(data, f"{number + 1:012d}-{lines + data.count(b'\n')}.txt")
        return number + 1

    def put(self, data: bytes, name: str) -> None:
        """Write a file that is there as a whole or not at all."""
        temp = f"{self.folder}/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(temp) as f:
            f.write(data)
        self.system.move(temp, f"{self.folder}/{name}")

    def forget(self, number: int) -> None:
        """Delete the segments up to a number, but for the newest of all."""
        found = self.segments()
        for k, (path, _) in found.items():
            if k <= number and k < max(found):
                self.system.delete_file(path)


class Recorder:
    """Seals what comes through a pipe into a log.

    A line's beginning is held until its end has come, or the pipe's.  Lines are sealed
    when nothing came for idle seconds, hold seconds after the first of them, or from
    most bytes on.  skip: lines at the beginning that the log has already.
    """

    def __init__(self, log: LineLog, idle: float = 0.02, hold: float = 0.2, most: int = 1 << 20, skip: int = 0):
        self.log, self.idle, self.hold, self.most, self.skip = log, idle, hold, most, skip

    def seal(self, data: bytes) -> None:
        if self.skip and data:
            lines = data.split(b"\n")[:-1]
            data = b"".join(x + b"\n" for x in lines[self.skip :])
            self.skip = max(0, self.skip - len(lines))
        if data:
            self.log.seal(data)

    def run(self, stream) -> None:
        """Read a stream with a file number to its end."""
        import os

        number, held, since = stream.fileno(), b"", 0.0
        while True:
            ready = select.select([number], [], [], self.idle if held else None)[0]
            data = os.read(number, 1 << 16) if ready else None
            if data:
                since = since if held else time.monotonic()
                held += data
            whole = held.rfind(b"\n") + 1
            if data == b"":
                self.seal(held if held.endswith(b"\n") or not held else held + b"\n")
                return
            if whole and (not ready or len(held) >= self.most or time.monotonic() - since >= self.hold):
                self.seal(held[:whole])
                held, since = held[whole:], time.monotonic()

    def start(self, stream) -> threading.Thread:
        thread = threading.Thread(target=self.run, args=(stream,), daemon=True)
        thread.start()
        return thread


class Segment(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class LogReader(DataSourceStreamReader):
    """The segments of a log that others write."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"segment": 0}

    def latestOffset(self) -> dict:
        return {"segment": LineLog(self.folder).last()[0]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = LineLog(self.folder).segments()
        return [Segment(found[k][0], k) for k in sorted(found) if start["segment"] < k <= end["segment"]]

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        with LineLog(self.folder).system.open_input_file(partition.path) as f:
            lines = f.read().split(b"\n")[:-1]
        for k in range(0, len(lines), 50_000):
            texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines[k : k + 50_000]]
            yield pa.RecordBatch.from_pydict({"value": pa.array(texts, pa.string()), "segment": pa.array([partition.number] * len(texts), pa.int64()), "at": pa.array(range(k, k + len(texts)), pa.int64())})

    def commit(self, end: dict) -> None:
        LineLog(self.folder).forget(end["segment"])


class CommandStream(LogReader):
    """A log that the reader itself fills from a shell command, which starts with the query and ends with it.

    resume "skip": the command prints the same again when it is run again, so what the
    log has is skipped; "append": what it prints is new each time.
    """

    def __init__(self, command: str, folder: str, resume: str):
        super().__init__(folder)
        self.command, self.resume = command, resume
        self.process = None

    def latestOffset(self) -> dict:
        if self.process is None:
            log = LineLog(self.folder)
            self.process = subprocess.Popen(["sh", "-c", self.command], stdout=subprocess.PIPE, start_new_session=True)
            Recorder(log, skip=log.last()[1] if self.resume == "skip" else 0).start(self.process.stdout)
        return super().latestOffset()

    def stop(self) -> None:
        import os
        import signal

        if self.process is not None and self.process.poll() is None:
            os.killpg(self.process.pid, signal.SIGTERM)


class CommandReader(DataSourceReader):
    """What a command prints until it ends, read in one task as it comes."""

    def __init__(self, command: str):
        self.command = command

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import subprocess

        with subprocess.Popen(["sh", "-c", self.command], stdout=subprocess.PIPE, text=True, errors="ignore") as p:
            for k, line in enumerate(p.stdout):
                yield line.rstrip("\n"), 0, k


class CommandSource(DataSource):
    """format("command"), for callers that opted in with allow=true; options: command, and for streams log (a folder) and resume."""

    @classmethod
    def name(cls) -> str:
        return "command"

    def schema(self) -> str:
        return "value string, segment long, at long"

    def allowed(self) -> str:
        if self.options.get("allow") != "true":
            raise PermissionError("commands run only with allow=true")
        return self.options["command"]

    def reader(self, schema) -> CommandReader:
        return CommandReader(self.allowed())

    def streamReader(self, schema) -> CommandStream:
        return CommandStream(self.allowed(), self.options["log"], self.options.get("resume", "skip"))


class LogSource(DataSource):
    """format("linelog"); options: log, the folder that a ``Recorder`` fills."""

    @classmethod
    def name(cls) -> str:
        return "linelog"

    def schema(self) -> str:
        return "value string, segment long, at long"

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options["log"])


def _lines(df: DataFrame, source: str) -> DataFrame:
    place = F.struct(F.col("segment").alias("f"), F.col("at").alias("b"))
    return df.select(F.col("value").alias("_raw"), place.alias("_place"), F.current_timestamp().alias(ARRIVAL), F.lit(source).alias(SOURCE))


def record(stream, folder: str, **how) -> threading.Thread:
    """Start sealing what comes through a pipe, such as sys.stdin, into the log of a folder."""
    return Recorder(LineLog(folder), **how).start(stream)


def follow_log(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of a log as a stream; one query may read a log, since its commits delete segments."""
    spark.dataSource.register(LogSource)
    return _lines(spark.readStream.format("linelog").option("log", folder).load(), "-")


def follow_command(spark: SparkSession, command: str, folder: str, allow: bool = False, resume: str = "skip") -> DataFrame:
    """What a shell command prints while it runs; only with allow, since it runs beside the driver."""
    if not allow:
        raise PermissionError("commands run only with allow=True")
    spark.dataSource.register(CommandSource)
    reader = spark.readStream.format("command").option("command", command).option("log", folder)
    return _lines(reader.option("allow", "true").option("resume", resume).load(), command)
