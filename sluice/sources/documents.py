"""JSON documents read in byte blocks: the elements of a list as rows, however large the document is.

What a byte means depends on whether it is inside a string, and how deep, which depends
on all bytes before.  So each block says, for each state that it may begin in, in which
it ends and by how much it changes the depth; a prefix scan over these summaries, one
row a block, gives every block its true state.  Then each block finds the commas
between elements, and yields the elements that begin in it, reading on to the end of the last.
"""

from __future__ import annotations

import sys
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.growing import store

# functions go to executors by value, so these need no package of their own
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a block.
BLOCK = 16 << 20
#: Outside strings, inside one, and behind a backslash inside one.
OUTSIDE, INSIDE, ESCAPED = range(3)

OPENING = np.zeros(256, np.int8)
OPENING[[*b"[{"]] = 1
OPENING[[*b"]}"]] = -1


def structure(data: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """(whether each byte is outside of strings, the state behind the last), for bytes that begin in a state."""
    n = len(data)
    place = np.arange(n)
    back = data == 0x5C
    # backslashes right before each byte: all since the last other byte, and one more where the block begins behind one
    last = np.maximum.accumulate(np.where(back, -1, place)) if n else place
    before = np.empty(n, np.int64)
    if n:
        before[0], before[1:] = 0, place[:-1] - last[:-1]
        reaches = np.concatenate([[True], last[:-1] < 0])
        before += reaches & (state == ESCAPED)
    quote = (data == 0x22) & (before % 2 == 0)
    parity = np.cumsum(quote) + (state != OUTSIDE)
    outside = (parity % 2 == 0) & ~quote
    if not n:
        return outside, state
    inside = parity[-1] % 2 == 1
    pending = bool(back[-1]) and before[-1] % 2 == 0
    return outside, (ESCAPED if pending else INSIDE) if inside else OUTSIDE


def summary(data: np.ndarray) -> list[int]:
    """For each state at the beginning: the state at the end, and the change of depth."""
    out = []
    for state in (OUTSIDE, INSIDE, ESCAPED):
        outside, end = structure(data, state)
        out += [end, int(OPENING[data[outside]].sum(dtype=np.int64))]
    return out


def boundaries(data: np.ndarray, state: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(places behind which an element begins, places at which one ends): the list's brackets and the commas between elements."""
    outside, _ = structure(data, state)
    step = np.where(outside, OPENING[data], 0)
    deep = depth + np.cumsum(step)
    comma = outside & (data == 0x2C) & (deep == 1)
    begins = comma | ((step == 1) & (deep == 1) & (data == 0x5B))
    ends = comma | ((step == -1) & (deep == 0) & (data == 0x5D))
    return np.flatnonzero(begins), np.flatnonzero(ends)


def opens(path: str) -> bool:
    """Whether pyarrow can open a path's file system."""
    try:
        return store(unquote(path)) is not None
    except (pa.ArrowException, OSError, ValueError):
        return False


def block_rows(spark: SparkSession, files: list[str], size: int) -> DataFrame:
    """(k, path, low, high, length) of each block of each file, dealt out over the tasks."""
    paths = [unquote(f) for f in files]
    lengths = {r["path"]: r["length"] for r in spark.read.format("binaryFile").load(sorted(set(paths))).select("path", "length").collect()}
    rows = [(k, p, low, min(n, low + size), n) for k, p in enumerate(paths) for n in [lengths[_same(p, lengths)]] for low in range(0, n, size)]
    made = spark.createDataFrame(rows, "k long, path string, low long, high long, length long")
    return made.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)), "k", "low")


def _same(path: str, known: dict) -> str:
    """The name under which a listing has a path."""
    return next(x for x in (path, path.replace("file:///", "file:/"), f"file:{path}") if x in known)


def read_range(path: str, low: int, high: int) -> np.ndarray:
    system, where = store(path)
    with system.open_input_file(where) as f:
        f.seek(low)
        return np.frombuffer(f.read(high - low), np.uint8)


def elements(spark: SparkSession, files: list[str], size: int | None = None) -> DataFrame:
    """(k, at, text): the elements of each file's list by file and byte place; a document that is no list is one element."""
    blocks = block_rows(spark, files, size or BLOCK)

    def summed(batches):
        for batch in batches:
            rows = batch.to_pylist()
            found = []
            for r in rows:
                data = read_range(r["path"], r["low"], r["high"])
                solid = np.flatnonzero(~np.isin(data, (9, 10, 13, 32, 0xEF, 0xBB, 0xBF)))
                found.append([*summary(data), int(data[solid[0]]) if len(solid) else -1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*batch.schema.names, "s"])

    names = "k long, path string, low long, high long, length long"
    # a row a block: 16 MB of a document are some 100 bytes here
    known = sorted(blocks.mapInArrow(summed, f"{names}, s array<long>").collect(), key=lambda r: (r["k"], r["low"]))
    placed, state, depth, first, file = [], OUTSIDE, 0, -1, None
    for r in known:
        if r["k"] != file:
            file, state, depth, first = r["k"], OUTSIDE, 0, -1
        s = r["s"]
        first = s[6] if first < 0 else first
        placed.append((r["k"], r["path"], r["low"], r["high"], r["length"], state, depth, first == 0x5B))
        state, depth = s[2 * state], depth + s[2 * state + 1]
    rows = spark.createDataFrame(placed, f"{names}, state long, depth long, listed boolean")
    rows = rows.repartition(max(1, min(len(placed), 4 * spark.sparkContext.defaultParallelism)), "k", "low")

    def found(batches):
        for batch in batches:
            for r in batch.to_pylist():
                yield from of_block(r)

    def of_block(r):
        if not r["listed"]:
            if r["low"] == 0:
                yield made(r, [0], [read_range(r["path"], 0, r["length"]).tobytes()])
            return
        data = read_range(r["path"], r["low"], r["high"])
        begins, ends = boundaries(data, r["state"], r["depth"])
        raw, texts, places = data.tobytes(), [], []
        for b in begins.tolist():
            e = int(np.searchsorted(ends, b, "right"))
            if e < len(ends):
                text = raw[b + 1 : ends[e]]
            else:
                text = raw[b + 1 :] + rest(r, data)
            if text.strip():
                texts.append(text)
                places.append(r["low"] + b + 1)
            if len(texts) == 20_000:
                yield made(r, places, texts)
                texts, places = [], []
        if texts:
            yield made(r, places, texts)

    def rest(r, data):
        """What follows a block up to the end of the element that reaches over it."""
        state, depth, at, out = r["state"], r["depth"], r["high"], []
        while True:
            outside, state = structure(data, state)
            depth += int(OPENING[data[outside]].sum(dtype=np.int64))
            if at >= r["length"]:
                return b"".join(out)
            high = min(r["length"], at + (1 << 16))
            data = read_range(r["path"], at, high)
            ends = boundaries(data, state, depth)[1]
            if len(ends):
                return b"".join([*out, data[: ends[0]].tobytes()])
            out.append(data.tobytes())
            at = high

    def made(r, places, texts):
        return pa.RecordBatch.from_arrays([pa.array([r["k"]] * len(texts), pa.int64()), pa.array(places, pa.int64()), pa.array([x.decode("utf-8-sig", "replace").strip() for x in texts], pa.string())], names=["k", "at", "text"])

    return rows.mapInArrow(found, "k long, at long, text string")
