"""Files that grow, as a stream: each whole line once, by byte offset, over restarts, rotation and truncation.

``spark.readStream.format("growing").option("path", ...)`` follows a file, a folder or a
pattern.  An offset says for each file how far it was read and holds digests of its
beginning.  A file whose beginning is another, or that became shorter, is a new one
and is read from its start; a file that has a new name but the beginning of one that
was read (a rotated log) goes on where that one stood.  A line counts once its newline is there.
"""

from __future__ import annotations

import fnmatch
import json
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.rows import ARRIVAL, SOURCE

#: A digest is taken of so many first bytes, as far as the file has them.
LEVELS = (16, 64, 256, 1024, 4096)
#: Bytes that one task reads, and bytes read at once.
BLOCK, CHUNK = 64 << 20, 1 << 20

# the source's classes go to executors by value, so these need no package of their own
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def store(path: str):
    """(file system, path on it) of a local path or a URI."""
    import os

    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def listing(path: str) -> dict[str, int]:
    """The files of a path, folder or pattern of names in a folder, with their sizes; hidden ones don't count."""
    from pyarrow import fs

    system, where = store(path)
    folder, _, name = where.rpartition("/")
    if any(c in name for c in "*?["):
        found = system.get_file_info(fs.FileSelector(folder or "/", allow_not_found=True))
        found = [x for x in found if fnmatch.fnmatch(x.base_name, name)]
    else:
        found = [system.get_file_info(where)]
        if found[0].type == fs.FileType.Directory:
            found = system.get_file_info(fs.FileSelector(where, recursive=True))
    return {x.path: x.size for x in found if x.is_file and not x.base_name.startswith((".", "_"))}


def whole_lines(file, size: int) -> int:
    """Where the last newline among the first size bytes ends; 0 without one."""
    at = size
    while at > 0:
        low = max(0, at - CHUNK)
        file.seek(low)
        found = file.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def beginning(file, end: int) -> list[int]:
    """Digests of a file's beginning, for each level that lies within its first end bytes."""
    file.seek(0)
    head = file.read(min(end, LEVELS[-1]))
    return [zlib.crc32(head[:n]) for n in LEVELS if n <= len(head)]


def continues(old: list, new: list) -> bool:
    """Whether a file (end, digests) may be an earlier state of another."""
    n = len(old[1])
    return old[0] <= new[0] and old[1] == new[1][:n]


def grown(start: dict, end: dict) -> list[tuple[str, int, int]]:
    """(file, from, to) of what came between two offsets."""
    gone = [x for path, x in start.items() if path not in end or not continues(x, end[path])]
    out = []
    for path, new in sorted(end.items()):
        old = start.get(path)
        if old is None or not continues(old, new):
            moved = [x for x in gone if x[1] and continues(x, new)]
            old = max(moved, key=lambda x: (len(x[1]), x[0])) if moved else [0, []]
            if moved:
                gone.remove(old)
        if old[0] < new[0]:
            out.append((path, old[0], new[0]))
    return out


class Block(InputPartition):
    """The lines of a file that begin at low or later and before high; low and last are where lines may begin and end at all."""

    def __init__(self, path: str, first: int, low: int, high: int, last: int):
        self.path, self.first, self.low, self.high, self.last = path, first, low, high, last


def blocks(path: str, low: int, high: int, size: int | None = None) -> list[Block]:
    size = size or BLOCK
    return [Block(path, low, k, min(high, k + size), high) for k in range(low, high, size)]


def lines_of(block: Block, file) -> Iterator[tuple[list[bytes], list[int]]]:
    """(lines, their byte offsets), some thousands at a time."""
    at = block.low
    if at > block.first:
        # the line that reaches over the border belongs to the block before
        at -= 1
        file.seek(at)
        while at < block.last:
            data = file.read(min(CHUNK, block.last - at))
            if not data:
                return
            found = data.find(b"\n")
            if found >= 0:
                at += found + 1
                break
            at += len(data)
    file.seek(at)
    rest, read = b"", at
    while at < block.high:
        data = file.read(min(CHUNK, block.last - read))
        if not data:
            return
        read += len(data)
        *lines, rest = (rest + data).split(b"\n")
        places = []
        for line in lines:
            if at >= block.high:
                lines = lines[: len(places)]
                break
            places.append(at)
            at += len(line) + 1
        if places:
            yield lines, places


class GrowingFiles(DataSource):
    """format("growing"); options: path; maxBytes that a batch takes at most (0: all); pace, a file with that number, read anew for each batch."""

    @classmethod
    def name(cls) -> str:
        return "growing"

    def schema(self) -> str:
        return "value string, file string, at long"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], int(self.options.get("maxBytes", "0")), self.options.get("pace"))


class GrowingReader(DataSourceStreamReader):
    """The first batch after a restart takes all that has come; later ones keep to max_bytes."""

    def __init__(self, path: str, max_bytes: int, pace: str | None = None):
        self.path, self.max_bytes, self.pace = path, max_bytes, pace
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def now(self) -> dict:
        out = {}
        for path, size in sorted(listing(self.path).items()):
            try:
                with store(path)[0].open_input_file(path) as f:
                    end = whole_lines(f, size)
                    if end:
                        out[path] = [end, beginning(f, end)]
            except FileNotFoundError:  # rotated since it was listed
                continue
        return out

    def latestOffset(self) -> dict:
        end = self.now()
        if self.pace:
            system, where = store(self.pace)
            with system.open_input_file(where) as f:
                self.max_bytes = int(f.read())
        if self.max_bytes and self.last is not None:
            left, held = self.max_bytes, {}
            ranges = {path: (low, high) for path, low, high in grown(self.last, end)}
            for path, x in end.items():
                low, high = ranges.get(path, (x[0], x[0]))
                if high - low > left:
                    with store(path)[0].open_input_file(path) as f:
                        cut = whole_lines(f, low + left)
                        if cut <= low and left == self.max_bytes:  # one line of more bytes than that
                            cut = high
                        held[path] = [max(cut, low), beginning(f, max(cut, low))]
                    left = 0
                else:
                    held[path] = x
                    left -= high - low
            end = {path: x for path, x in held.items() if x[0]}
        self.last = end
        return {"files": json.dumps(end)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, now = json.loads(start["files"]), json.loads(end["files"])
        if self.last is None:
            self.last = now
        return [b for path, low, high in grown(before, now) for b in blocks(path, low, high)]

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        with store(partition.path)[0].open_input_file(partition.path) as f:
            for lines, places in lines_of(partition, f):
                texts = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in lines]
                yield pa.RecordBatch.from_pydict({"value": pa.array(texts, pa.string()), "file": pa.array([partition.path] * len(texts), pa.string()), "at": pa.array(places, pa.int64())})

    def commit(self, end: dict) -> None:
        pass


def tail(spark: SparkSession, path: str, max_bytes: int = 0, pace: str | None = None) -> DataFrame:
    """Lines of growing files as they are written: _raw, _place (file, offset), _arrival and _source.

    A file system that pyarrow opens must hold them, and all executors must see it.
    """
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format("growing").option("path", path).option("maxBytes", str(max_bytes))
    lines = (reader.option("pace", pace) if pace else reader).load()
    place = F.struct(F.col("file").alias("f"), F.col("at").alias("b"))
    return lines.select(F.col("value").alias("_raw"), place.alias("_place"), F.current_timestamp().alias(ARRIVAL), F.regexp_extract("file", r"[^/]*$", 0).alias(SOURCE))
