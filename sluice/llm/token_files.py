"""Token-id files with a minimal perfect hash index (operator 2).

A dataset is a folder of shards and a directory.  A shard is one file:

    64 bytes   magic, version, bytes an id, records, keys, ids, length of the index
    index      perfect hash of the keys; by slot: fingerprint, first record, records;
               by record: where its ids start
    keys       lengths and UTF-8 of the keys by record, for listing a shard
    payload    the raw ids, little-endian, one document after the other
    newline    one byte, ignored

Shards hold consecutive ranges of doc_id.  Each writing task leaves one small file
more, which lists its shards; from these the directory is made and stored: a row for
each shard with its file, its first and last key, and where its payload begins.  A
keyed read finds the shard there, reads the shard's head and index, finds the record
at once by the perfect hash, rejects strange keys by the fingerprint, and reads the
bytes of the record's ids, whatever the dataset holds besides.
"""

from __future__ import annotations

import struct
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blobs, file_range, read_blobs, tidy, whole_text, write_blobs
from .mph import PerfectHash, digests
from .tokens import encoded, encoder, release

MAGIC, LIST_MAGIC = b"SLTOKIDS", b"SLTOKLST"
HEAD = "<8sIIQQQQ16x"
#: Ids of a shard at most, unless one document has more.
SHARD_IDS = 6_000_000
#: A shard in a task's list: first and last key, whether a null key comes before, records, ids, where the payload begins.
LISTED = "<qq?QQQ"


def key_bytes(key) -> bytes:
    """A null doc_id is a key of its own."""
    return b"\0" if key is None else str(key).encode()


def build_shard(keys: list[bytes], ids: list[bytes], width: int) -> bytes:
    """Records in their order; repeated keys must be adjacent."""
    starts = np.concatenate([[0], np.cumsum([len(x) // width for x in ids])]).astype("<u8")
    first = [k for k in range(len(keys)) if not k or keys[k] != keys[k - 1]]
    runs = np.diff([*first, len(keys)]).astype("<u4")
    place, check = digests([keys[k] for k in first])
    mph = PerfectHash.build(place)
    slot = mph.slots(place)
    by_slot = np.zeros(len(first), [("check", "<u4"), ("first", "<u4"), ("runs", "<u4")])
    by_slot["check"][slot], by_slot["first"][slot], by_slot["runs"][slot] = check, first, runs
    hashed = mph.to_bytes()
    index = struct.pack("<Q", len(hashed)) + hashed + by_slot.tobytes() + starts.tobytes()
    names = np.array([len(k) for k in keys], "<u4").tobytes() + b"".join(keys)
    head = struct.pack(HEAD, MAGIC, 1, width, len(keys), len(first), int(starts[-1]), len(index))
    return b"".join([head, index, struct.pack("<Q", len(names)), names, *ids])


class Shard:
    """A shard's bytes, read in place; those before the payload suffice to find records."""

    def __init__(self, data: bytes):
        magic, version, width, self.records, keys, self.ids, size = struct.unpack_from(HEAD, data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEAD)
        (n,) = struct.unpack_from("<Q", data, at)
        self.mph = PerfectHash.from_bytes(data[at + 8 : at + 8 + n])
        self.by_slot = np.frombuffer(data, [("check", "<u4"), ("first", "<u4"), ("runs", "<u4")], keys, at + 8 + n)
        self.starts = np.frombuffer(data, "<u8", self.records + 1, at + 8 + n + self.by_slot.nbytes)
        at += size
        (n,) = struct.unpack_from("<Q", data, at)
        self.names, self.payload = data[at + 8 : at + 8 + n], at + 8 + n
        self.data, self.dtype = data, np.dtype(f"<u{width}")

    def keys(self) -> list[bytes]:
        ends = np.cumsum(np.frombuffer(self.names, "<u4", self.records)).tolist()
        text = self.names[4 * self.records :]
        return [text[a:b] for a, b in zip([0, *ends], ends)]

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(first record, number of records) of each key; no records for a strange one."""
        place, check = digests(keys)
        slot = self.mph.slots(place)
        first, runs = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        known = slot >= 0
        known[known] = self.by_slot["check"][slot[known]] == check[known]
        first[known], runs[known] = self.by_slot["first"][slot[known]], self.by_slot["runs"][slot[known]]
        return first, runs

    def at(self, record: int) -> np.ndarray:
        a, b = int(self.starts[record]), int(self.starts[record + 1])
        return np.frombuffer(self.data, self.dtype, b - a, self.payload + a * self.dtype.itemsize)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, pieces: str, end_id: int, shard_ids: int = SHARD_IDS) -> None:
    """Encode (doc_id, text) and write shards in ascending doc_id order (nulls first).

    A null text is an empty one; every document gets end_id at its end.  Rows of
    one doc_id are kept, as records side by side.  An empty table leaves no
    shard.  The one shuffle deals the texts into ranges of doc_id (and of a hash,
    so that many rows of one doc_id spread).
    """

    def shards(batches):
        keys, ids, size, width, listed = [], [], 0, encoder(tokenizer, pieces).dtype.itemsize, []

        def closed():
            nonlocal keys, ids, size
            blob = build_shard([key_bytes(k) for k in keys], ids, width)
            known = [k for k in keys if k is not None] or [0, -1]
            shard = Shard(blob)
            listed.append(struct.pack(LISTED, known[0], known[-1], keys[0] is None, shard.records, shard.ids, shard.payload))
            keys, ids, size = [], [], 0
            return pa.RecordBatch.from_pydict({"blob": pa.array([blob], pa.binary())})

        for key, x in encoded(batches, tokenizer, pieces, end_id):
            if size and size + len(x) // width > shard_ids:
                yield closed()
            keys.append(key)
            ids.append(x)
            size += len(x) // width
        if keys:
            yield closed()
            yield pa.RecordBatch.from_pydict({"blob": pa.array([LIST_MAGIC + b"".join(listed)], pa.binary())})

    rows = docs.select("doc_id", whole_text().alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    write_blobs(dealt.select("doc_id", "text").mapInArrow(tidy(shards), "blob binary"), "blob", path)
    write_directory(docs.sparkSession, path)


def write_directory(spark: SparkSession, path: str) -> None:
    """Store the directory.  Of each task's files only the last one, its list, is read."""
    lists = [r["file"] for r in blobs(spark, path).groupBy("part").agg(F.max_by("path", "number").alias("file")).collect()]

    def rows(batches):
        release()
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = struct.iter_unpack(LISTED, content[len(LIST_MAGIC) : -1])
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (part, k, *x))) for k, x in enumerate(found)], schema)

    schema = pa.schema([(n, pa.bool_() if n == "has_null" else pa.int64()) for n in ("part", "number", "first_key", "last_key", "has_null", "records", "ids", "payload")])
    out = "part long, number long, first_key long, last_key long, has_null boolean, records long, ids long, payload long"
    if lists:
        read = spark.read.format("binaryFile").load(lists)
        part = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("long")
        found = read.select(part.alias("part"), "content").mapInArrow(tidy(rows), out)
        # the k-th shard of a task is its file number k
        own = blobs(spark, path).select("part", "number", F.col("path").alias("file"))
        found = found.join(own, ["part", "number"])
    else:
        found = spark.createDataFrame([], f"{out}, file string")
    found.repartitionByRange("part", "number").sortWithinPartitions("part", "number").write.mode("overwrite").parquet(f"{path}/_directory")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, first_key, last_key, has_null, records, ids, payload, file) of each shard, as stored."""
    return spark.read.parquet(f"{path}/_directory")


def shards_of(spark: SparkSession, path: str, keys: list[int | None]) -> list:
    """The directory's rows of the shards that can hold these keys."""
    where = F.lit(False)
    for k in dict.fromkeys(keys):
        where |= F.col("has_null") if k is None else (F.col("first_key") <= k) & (F.col("last_key") >= k)
    return directory(spark, path).filter(where).orderBy("part", "number").collect()


class Reader:
    """Keyed reads on the driver: the directory, one shard's head and index, and the bytes of the ids asked for."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 8):
        """keep: shards whose index stays in memory."""
        self.spark, self.path, self.keep = spark, path, keep
        self.held: OrderedDict[str, Shard] = OrderedDict()

    def shard(self, row) -> Shard:
        if row["file"] not in self.held:
            self.held[row["file"]] = Shard(file_range(self.spark, row["file"], 0, row["payload"]))
            while len(self.held) > self.keep:
                self.held.popitem(last=False)
        self.held.move_to_end(row["file"])
        return self.held[row["file"]]

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each record of a key, none if the key is unknown."""
        out = []
        for row in shards_of(self.spark, self.path, [key]):
            shard = self.shard(row)
            (first,), (runs,) = shard.find([key_bytes(key)])
            if runs:
                a, b, width = int(shard.starts[first]), int(shard.starts[first + runs]), shard.dtype.itemsize
                ids = np.frombuffer(file_range(self.spark, row["file"], shard.payload + a * width, (b - a) * width), shard.dtype)
                cuts = (shard.starts[first + 1 : first + runs].astype(np.int64) - a).tolist()
                out += np.split(ids, cuts)
        return out


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(part, number, record, doc_id, start_in_shard, n_tokens, ids) of every record.

    Each key goes through its shard's perfect hash and fingerprint, as a keyed
    read does; ids are little-endian unsigned 32-bit integers.
    """

    def records(batches):
        release()
        for batch in batches:
            for part, number, content in zip(*(c.to_pylist() for c in batch.columns)):
                if content.startswith(LIST_MAGIC):
                    continue
                shard = Shard(content)
                keys = shard.keys()
                first, runs = shard.find(keys)
                if not runs.all():
                    raise ValueError("a key is missing from its index")
                # the k-th record of a repeated key is its first record and k
                record = first + np.arange(len(keys)) - np.searchsorted(first, first)
                starts = shard.starts[record].astype(np.int64)
                sizes = shard.starts[record + 1].astype(np.int64) - starts
                ids = [None if k == b"\0" else int(k) for k in keys]
                cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // 1_000_000, prepend=-1))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)]):
                    n = b - a
                    payload = pa.array([shard.at(r).astype("<u4").tobytes() for r in record[a:b].tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, part)), pa.array(np.full(n, number)), pa.array(record[a:b]), pa.array(ids[a:b], pa.int64()), pa.array(starts[a:b]), pa.array(sizes[a:b]), payload],
                        schema=schema,
                    )

    schema = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("record", pa.int64()), ("doc_id", pa.int64()), ("start_in_shard", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    out = "part long, number long, record long, doc_id long, start_in_shard long, n_tokens long, ids binary"
    return read_blobs(spark, path).mapInArrow(tidy(records), out)


def lookup(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """(doc_id, ids) of the asked keys; unknown ones are left out.

    Executors read the shards that the directory names for these keys, each once.
    The list of keys is the caller's and small; for many keys join read_token_files.
    """
    asked = [key_bytes(k) for k in keys]

    def answers(batches):
        for batch in batches:
            rows = []
            for content in batch.column(0).to_pylist():
                shard = Shard(content)
                first, runs = shard.find(asked)
                for key, f, n in zip(keys, first.tolist(), runs.tolist()):
                    rows += [{"doc_id": key, "ids": shard.at(r).astype("<u4").tobytes()} for r in range(f, f + n)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())]))

    files = [r["file"] for r in shards_of(spark, path, keys)]
    if not files:
        return spark.createDataFrame([], "doc_id long, ids binary")
    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(tidy(answers), "doc_id long, ids binary")


def with_global_starts(records: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds start: the ids of all records of the shards before, and in the shard; shards is the directory.

    Only one row a shard meets in the running sum.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("part", "number", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return records.join(base, ["part", "number"]).withColumn("start", F.col("base") + F.col("start_in_shard"))
