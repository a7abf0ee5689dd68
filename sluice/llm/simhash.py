"""SimHash near-duplicates by a byte-position inverted index with count filtering (operator 10).

Fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so
they agree in at least 5 positional bytes.  Postings of single bytes would hold a
256th of the corpus each, so the index has a posting for the values of every 3 byte
positions, 56 for each distinct fingerprint, or of every 4 positions, 70, where there are
too many fingerprints for 3.  Two fingerprints that agree in 5 bytes meet in at least 10
of them, or in 5 of those of 4.  The meetings of each pair are tallied, pairs that reach
this guaranteed minimum are kept, and their bits compared.

A posting of more than HOT fingerprints emits no pairs.  Its fingerprints go to
postings of 5 byte positions, where those that agree in 5 bytes meet: only 3 bytes are
free there, which bounds such a posting by 2^24 distinct fingerprints, and it yields a
spanning forest of its links.  Pairs that meet in no hot posting have all their
meetings tallied, so no link is lost.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, last_made, saved, tidy, whole_text

MAX_BITS = 3
#: Distinct fingerprints up to which postings are of 3 byte positions; beyond, of 4, of whose values there are 256 times as many.
SHORT_POSTINGS = 1 << 26
#: The byte positions of hot postings.
SUBSETS = list(combinations(range(8), 8 - MAX_BITS))
#: Fingerprints of a posting from which it is solved by the longer ones.
HOT = 8
#: Above this a posting is probed by flipped bits instead of compared all with all.
PROBE_FROM = 60_000


def fingerprint(text: str, digest) -> int:
    """The 64 majority bits of the hashes of a text's 3-word shingles, A-Z lower-cased; 0 without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < 3:
        return digest(b" ".join(words))
    n = len(words) - 2
    h = np.fromiter(map(digest, map(b" ".join, zip(words, words[1:], words[2:]))), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        part = h[k : k + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of (doc_id, text), fp as a signed long; a null text is an empty one."""

    def rows(batches):
        import xxhash

        digest = partial(xxhash.xxh64_intdigest, seed=42)
        for batch in batches:
            fp = np.array([fingerprint(t.as_py(), digest) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "fp": pa.array(fp.view(np.int64))})

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(tidy(rows), "doc_id long, fp long")


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Vectorised union of a[k] with b[k]; roots are the smallest of their sets."""
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)


def close_sets(values: np.ndarray, probe_from: int = PROBE_FROM) -> np.ndarray:
    """The root of each of these sorted distinct fingerprints, linked at MAX_BITS or fewer."""
    n = len(values)
    parent = np.arange(n)
    if n <= probe_from:
        step = max(1, 2_000_000 // n)
        for k in range(0, n, step):
            part = values[k : k + step]
            roots = _find(parent, np.arange(n))
            i, j = np.nonzero((np.bitwise_count(part[:, None] ^ values[None, k:]) <= MAX_BITS) & (roots[k : k + step, None] != roots[None, k:]))
            unite(parent, i + k, j + k)
    else:
        free = int(np.bitwise_or.reduce(values ^ values[0]))
        bits = [1 << b for b in range(64) if free >> b & 1]
        for size in range(1, MAX_BITS + 1):
            for flips in combinations(bits, size):
                other = values ^ np.uint64(sum(flips))
                at = np.searchsorted(values, other).clip(max=n - 1)
                hit = np.flatnonzero(values[at] == other)
                unite(parent, hit, at[hit])
    return _find(parent, np.arange(n))


def keyed_by(fingerprints: DataFrame, subsets: list[tuple[int, ...]]) -> DataFrame:
    """(key, fp): a posting of each fingerprint (fp) for each subset of byte positions, sorted by key in each task."""

    def postings(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            columns = [(fp >> np.uint64(8 * p)) & np.uint64(255) for p in range(8)]
            for k, subset in enumerate(subsets):
                key = np.full(len(fp), k, np.uint64)
                for p in subset:
                    key = (key << np.uint64(8)) | columns[p]
                yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "fp": pa.array(fp.view(np.int64))})

    return fingerprints.select("fp").mapInArrow(postings, "key long, fp long").repartition("key").sortWithinPartitions("key")


def whole_postings(batches):
    """(keys, fingerprints) of sorted batches, cut where a posting ends."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        key, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))  # the last posting may go on
        if held and (cut or key[0] != held[0][0][-1]):
            held.append((key[:cut], fp[:cut]))
            yield tuple(np.concatenate(x) for x in zip(*held))
            held = []
        elif cut:
            yield key[:cut], fp[:cut]
        held.append((key[cut:], fp[cut:]))
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def runs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    return starts, np.diff(starts, append=len(key))


def meetings(distinct: DataFrame, hot: int, positions: int) -> DataFrame:
    """(u, v) for each posting in which two fingerprints meet, u the larger as unsigned; (u, null) for u in a hot posting."""

    def rows(batches):
        for key, fp in whole_postings(batches):
            starts, sizes = runs_of(key)
            u, v = [], []
            for n in np.unique(sizes[(sizes > 1) & (sizes <= hot)]).tolist():
                group = fp[starts[sizes == n][:, None] + np.arange(n)]
                i, j = np.triu_indices(n, 1)
                a, b = group[:, i].ravel(), group[:, j].ravel()
                u.append(np.maximum(a, b))
                v.append(np.minimum(a, b))
            if u:
                yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(u).view(np.int64)), "v": pa.array(np.concatenate(v).view(np.int64))})
            large = [fp[s : s + n] for s, n in zip(starts[sizes > hot].tolist(), sizes[sizes > hot].tolist())]
            if large:
                own = np.unique(np.concatenate(large)).view(np.int64)
                yield pa.RecordBatch.from_pydict({"u": pa.array(own), "v": pa.nulls(len(own), pa.int64())})

    return keyed_by(distinct, list(combinations(range(8), positions))).mapInArrow(tidy(rows), "u long, v long")


def forests(fingerprints: DataFrame) -> DataFrame:
    """(u, v): a spanning forest of the verified links of each posting of 5 byte positions."""

    def rows(batches):
        for key, fp in whole_postings(batches):
            starts, sizes = runs_of(key)
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= MAX_BITS]
            u, v = [np.maximum(fp[two], fp[two + 1])], [np.minimum(fp[two], fp[two + 1])]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                values = np.unique(fp[s : s + n])
                root = close_sets(values)
                moved = root != np.arange(len(values))
                u.append(values[moved])
                v.append(values[root[moved]])
            yield pa.RecordBatch.from_pydict({"u": pa.array(np.concatenate(u).view(np.int64)), "v": pa.array(np.concatenate(v).view(np.int64))})

    return keyed_by(fingerprints, SUBSETS).mapInArrow(tidy(rows), "u long, v long")


def links(distinct: DataFrame, hot: int | None = None, positions: int | None = None) -> DataFrame:
    """(u, v): verified links of distinct fingerprints (fp), those of hot postings as spanning forests.

    positions: the bytes of a posting, by the number of fingerprints, so that postings
    stay short and the tally stays the way by which links are found.
    """
    positions = positions or (3 if distinct.count() <= SHORT_POSTINGS else 4)
    minimum = comb(8 - MAX_BITS, positions)
    met = saved(meetings(distinct, hot or HOT, positions).groupBy("u", "v").agg(F.count("*").alias("n")))
    tallied = met.filter((F.col("n") >= minimum) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)).select("u", "v")
    crowded = met.filter("v is null").select(F.col("u").alias("fp"))
    return tallied.union(forests(crowded)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (u, v): large and small stars in turn, until nothing changes.

    Each round is written to the shared folder, and the one before deleted; the roots are the smallest longs.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.crc32(F.concat_ws(",", "u", "v")))).first())

    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    edges = saved(edges.filter("u != v").select(*pair).distinct())
    now, folder = mark(edges), last_made()
    while now[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(low.select("u", F.col("m").alias("v")))
        edges = saved(small.select(*pair).distinct())
        drop(edges.sparkSession, folder)
        before, now, folder = now, mark(edges), last_made()
        if now == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of each row of (doc_id, text): the smallest doc_id reachable over links.

    Rows of one doc_id stay rows; documents without words share fingerprint 0 and
    are linked like any other; a null doc_id counts only if its component has no
    other.  An empty table gives no rows, texts may be of any length, other columns
    are not looked at.  Hot fingerprints meet as one row; nothing is collected.
    """
    found = saved(fingerprints(docs))
    distinct = saved(found.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(links(distinct))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = rooted.join(lowest, "root").select("fp", "component_id")
    return found.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def hex16(column: str):
    return F.lpad(F.lower(F.hex(column)), 16, "0")
