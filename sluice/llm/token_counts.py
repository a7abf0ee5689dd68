"""Document lengths from flat token files without an index (operator 7).

A flat file is nothing but ids, documents one after the other, each closed by an
end-of-document id.  It is kept in blocks of equal size that pay no heed to
documents.  Each block is searched for end ids in one vectorised pass; a prefix
scan over one summary row a block (ends seen, ids behind the last end) then says
how many documents lie before a block and how many ids of its first document lie
in the blocks before.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_blobs, saved, tidy, whole_text, write_blobs
from .tokens import encoded, release

#: A file that starts so lists the doc_ids of a part; all others are ids only.
KEYS_MAGIC = bytes.fromhex("8f53c1d207b94e6aa1d95be0374c2f16")
BLOCK_BYTES = 8_000_000
NULL_KEY = -(1 << 63)


def write_flat_files(docs: DataFrame, path: str, tokenizer: str, pieces: str, end_id: int, block_bytes: int = BLOCK_BYTES) -> None:
    """Encode (doc_id, text), append end_id, and write ids in blocks of block_bytes, and the doc_ids apart.

    A null text is an empty one; in texts, strings of special tokens are ordinary
    text, so end_id occurs at ends only.  Documents follow in the order in which tasks
    read them; nothing is shuffled.  A block's file ends in one newline byte,
    which is not part of the ids.  Repeated rows are documents of their own, an empty
    table leaves no block, and other columns are not looked at.
    """

    def blocks(batches):
        keys, parts, size = [], [], 0
        for key, ids in encoded(batches, tokenizer, pieces, end_id, plain=True, chars=3_000_000):
            keys.append(NULL_KEY if key is None else key)
            parts.append(ids)
            size += len(ids)
            if size >= block_bytes:
                data = b"".join(parts)
                whole = size - size % block_bytes
                for k in range(0, whole, block_bytes):
                    yield pa.RecordBatch.from_pydict({"blob": pa.array([data[k : k + block_bytes]], pa.binary())})
                parts, size = [data[whole:]], size - whole
        if size:
            yield pa.RecordBatch.from_pydict({"blob": pa.array([b"".join(parts)], pa.binary())})
        if keys:
            yield pa.RecordBatch.from_pydict({"blob": pa.array([KEYS_MAGIC + np.array(keys, "<i8").tobytes()], pa.binary())})

    write_blobs(docs.select("doc_id", whole_text().alias("text")).mapInArrow(tidy(blocks), "blob binary"), "blob", path)


def count_tokens(spark: SparkSession, path: str, end_id: int, width: int) -> DataFrame:
    """(part, ordinal, start, n_tokens) of each document of the flat files, its end id included.

    Ids behind the last end id of a part are no document and are left out.
    """
    dtype = np.dtype(f"<u{width}")

    def search(batches):
        release()
        for batch in batches:
            for part, number, content in zip(*(c.to_pylist() for c in batch.columns)):
                if content.startswith(KEYS_MAGIC):
                    continue
                ids = np.frombuffer(content, dtype, (len(content) - 1) // width)
                ends = np.flatnonzero(ids == end_id)
                lengths = np.diff(ends, prepend=-1)
                tail = len(ids) - (int(ends[-1]) + 1 if len(ends) else 0)
                n = len(ends)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(n + 1, part), pa.int64()),
                        "number": pa.array(np.full(n + 1, number), pa.int64()),
                        "k": pa.array(np.arange(-1, n), pa.int64()),
                        "n": pa.array([n, *lengths.tolist()], pa.int64()),
                        "at": pa.array([len(ids), *(ends + 1 - lengths).tolist()], pa.int64()),
                        "tail": pa.array([tail] + [0] * n, pa.int64()),
                    }
                )

    found = saved(read_blobs(spark, path).mapInArrow(tidy(search), "part long, number long, k long, n long, at long, tail long"))
    # k = -1 is a block's summary: n ends, at ids, tail ids behind the last end
    order = Window.partitionBy("part").orderBy("number")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0)
    summary = (
        found.filter("k = -1")
        .select(
            "part", "number", "tail", F.col("n").alias("ends"),
            F.coalesce(F.sum("n").over(before), none).alias("docs_before"),
            F.coalesce(F.sum("at").over(before), none).alias("ids_before"),
            F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(order).alias("run"),
        )
        # a run: a block with an end, and the blocks without one that follow it
        .withColumn("next_carry", F.sum("tail").over(Window.partitionBy("part", "run").orderBy("number")))
        .withColumn("carry", F.coalesce(F.lag("next_carry").over(order), none))
        .select("part", "number", "docs_before", "ids_before", "carry")
    )
    first = F.col("k") == 0
    return (
        found.filter("k >= 0")
        .join(summary, ["part", "number"])
        .select(
            "part",
            (F.col("docs_before") + F.col("k")).alias("ordinal"),
            (F.col("ids_before") + F.col("at") - F.when(first, F.col("carry")).otherwise(0)).alias("start"),
            (F.col("n") + F.when(first, F.col("carry")).otherwise(0)).alias("n_tokens"),
        )
    )


def document_keys(spark: SparkSession, path: str) -> DataFrame:
    """(part, ordinal, doc_id) in the order of the flat files."""

    def listed(batches):
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if content.startswith(KEYS_MAGIC):
                    keys = np.frombuffer(content, "<i8", (len(content) - 1 - len(KEYS_MAGIC)) // 8, len(KEYS_MAGIC))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "part": pa.array(np.full(len(keys), part), pa.int64()),
                            "ordinal": pa.array(np.arange(len(keys)), pa.int64()),
                            "doc_id": pa.array(keys, pa.int64(), mask=keys == NULL_KEY),
                        }
                    )

    return read_blobs(spark, path).mapInArrow(tidy(listed), "part long, ordinal long, doc_id long")
