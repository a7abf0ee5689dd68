"""N-gram Jaccard join with PartEnum signatures (operator 13).

A document is the set of its 4-word shingles.  Set sizes fall into bands, each ending
where a set of its first size has at most 0.85 of the elements; linked sets lie in
one band or in neighbouring ones, and differ there in at most k elements.  The
domain of shingles (their hashes) is cut into n1 partitions, so that linked sets
differ in at most k2 elements of one of them, and each partition into n2 parts, of
which n2 - k2 then agree.  A signature is what a set has in such a subset of the
parts of a partition; all subsets are enumerated, so linked sets share one.  There are
some more partitions than that takes, so linked sets agree in slack + 1 of them; a set
that has empty subsets in no more than slack partitions need not sign those, which
would bring together sets that have nothing in common.

1. Sets that share a signature form a list; lists of the same sets are one.  The members of
   a list meet as sketches: bits by cell of the domain that tell whether a set has an odd
   number of elements there, so that two sketches differ in no more bits than the sets do
   in elements.  In ROUNDS rounds each member names the first one that its sketch lets it
   link to, such pairs are compared element by element, and those that link are one
   cluster, of which no pair is looked at any more.
2. Lists in which more members may link than have been named are looked at once more for
   pairs across clusters, and so are those of more than TILE members, which the rounds only
   cut into runs.  Lists of more than DIRECT * CROWD members emit pairs across clusters, if these are at most CROWD for each
   member; the sets of others are signed anew by the next scheme, whose signatures cover
   more elements and which finds all links by itself.  The last scheme's lists emit all
   pairs across clusters.

Equal sets are one from the start.  Sets go by a 64-bit hash of their elements, equal
documents by one of 128 bits.
"""

from __future__ import annotations

from functools import lru_cache, reduce
from itertools import combinations
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MADE, clear, drop, last_made, saved, tidy, whole_text
from .collocations import is_set, mixed
from .simhash import components, runs_of
from .words import bytes_of, chunks, packed, split_words

SHINGLE, PERCENT = 4, 85
#: (k2, parts of a subset) of each scheme.
SCHEMES = ((1, 1), (2, 3), (3, 3))
#: In the first scheme, subsets of two parts for sets that may differ in fewer elements than this.
SMALL_K = 8
#: Pairs across clusters for each member, above which the sets of a long list are signed anew.
CROWD = 16
#: Lists of up to DIRECT * CROWD members meet in tasks, TILE by TILE members at a time.
DIRECT, TILE = 256, 256
#: Members of a list of more than TILE that each of its runs meets.
PIVOTS = 16
#: Rounds in which sets name one other each, before pairs across clusters are compared.
ROUNDS = 1
#: Signatures of a bucket, as a power of two, and the fewest buckets.
TABLE_BITS, BUCKETS = 20, 1024
#: Bits of the table of wanted documents, as a power of two: 16 MB.
WANTED_BITS = 27
#: Signatures that a task sorts into buckets at once, pairs that it compares at once.
BLOCK, PAIRS = 1 << 21, 1 << 18
#: Bytes of texts that are worked on at once.
CHUNK = 4 << 20


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    import xxhash

    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    each = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = each[coded.indices.to_numpy(zero_copy_only=False)]
    whole = mixed([w[k : len(w) - size + 1 + k] for k in range(size)]) if len(w) >= size else w[:0]
    out, at = [], 0
    for n in counts.tolist():
        if n >= size:
            out.append(np.unique(whole[at : at + n - size + 1]))
        elif n:
            out.append(mixed([np.array([n], np.uint64), *(w[at + k : at + k + 1] for k in range(n))]))
        else:
            out.append(w[:0])
        at += n
    return out


@lru_cache(maxsize=1)
def _bands(percent: int, last: int) -> np.ndarray:
    starts = [1]
    while starts[-1] <= last:
        starts.append(100 * starts[-1] // percent + 1)
    return np.array(starts)


def band(n: int, percent: int = PERCENT) -> tuple[int, int, int]:
    """(number of the band of a size, its last size, the last size of the next one)."""
    starts = _bands(percent, 1 << max(16, (2 * n).bit_length()))
    j = int(np.searchsorted(starts, n, "right")) - 1
    return j, int(starts[j + 1]) - 1, int(starts[j + 2]) - 1


def most_different(size: int, percent: int = PERCENT) -> int:
    """Elements in which two linked sets of at most this size can differ."""
    return 2 * size * (100 - percent) // (100 + percent)


def parameters(k: int, scheme: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, slack): partitions, parts of each, how many parts of one may differ, and the partitions more than one that agree."""
    k2, agree = SCHEMES[scheme]
    k2 = min(k2, k)
    few = k < SMALL_K
    # of k partitions some k / 400 have an empty part
    slack = 0 if few else int(k / 400 + 3 * sqrt(k / 400) + 1.5)
    return k // (k2 + 1) + 1 + slack, k2 + (2 if not scheme and few else agree), k2, slack


def signatures(elements: np.ndarray, scheme: int = 0, percent: int = PERCENT) -> np.ndarray:
    """The signatures of a set, sorted distinct hashes: those of its band, and of the next one, where it meets larger sets."""
    if not len(elements):
        return np.zeros(0, np.uint64)
    j, last, following = band(len(elements), percent)
    if scheme:  # other partitions
        elements = np.sort(mixed([np.full(len(elements), scheme, np.uint64), elements]))
    content = mixed([elements])
    top = elements >> np.uint64(32)
    out = []
    for instance, size in ((j, last), (j + 1, following)):
        n1, n2, k2, slack = parameters(most_different(size, percent), scheme)
        cell = ((top * np.uint64(n1 * n2)) >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        sums = np.zeros(n1 * n2, np.uint64)
        sums[cell[starts]] = np.add.reduceat(content, starts)
        sums = sums.reshape(n1, n2)
        vacant = (sums == 0).sum(axis=1)
        weak = vacant >= n2 - k2  # partitions of which a subset is empty
        skip = slack > 0 and int(weak.sum()) <= slack
        for s, subset in enumerate(combinations(range(n2), n2 - k2)):
            head = np.full(n1, (instance << 16) + (scheme << 8) + s, np.uint64)
            signature = mixed([head, np.arange(n1, dtype=np.uint64), *(sums[:, p] for p in subset)])
            out.append(signature[sums[:, subset].any(axis=1)] if skip else signature)
    return np.concatenate(out)


def identity(elements: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    import xxhash

    both = xxhash.xxh3_128_intdigest(elements.tobytes())
    return (both >> 64) - (1 << 63), (both & ((1 << 64) - 1)) - (1 << 63)


def histogram(elements: np.ndarray) -> bytes:
    """A bit for each cell of the domain: whether the elements there are odd in number.  At least 64 cells, 2 to 4 for each element of larger sets."""
    bits = max(6, (len(elements) - 1).bit_length() + 1)
    cells = (elements >> np.uint64(20)) & np.uint64((1 << bits) - 1)
    odd = np.bincount(cells.astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, width: int) -> np.ndarray:
    """Sketches, a row each, with so many words: cells that become one add up."""
    while words.shape[1] > width:
        half = words.shape[1] // 2
        words = words[:, :half] ^ words[:, half:]
    return words


def cells_apart(a: bytes, b: bytes) -> int:
    """How much two sketches differ: no more than the sets do."""
    x, y = (np.frombuffer(c, np.uint64).reshape(1, -1) for c in (a, b))
    width = min(x.shape[1], y.shape[1])
    return int(np.bitwise_count(folded(x, width) ^ folded(y, width)).sum())


def may_link(raw: np.ndarray, at: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and sketches let rows i and j link; a row's sketch is the words from at on."""
    ok = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
    width = np.diff(at)
    least = np.minimum(width[i], width[j])
    for w in np.unique(least[ok]).tolist():
        these = np.flatnonzero(ok & (least == w))
        rows, where = np.unique(np.concatenate([i[these], j[these]]), return_inverse=True)
        cells = np.empty((len(rows), w), np.uint64)
        for wide in np.unique(width[rows]).tolist():
            same = np.flatnonzero(width[rows] == wide)
            cells[same] = folded(raw[at[rows[same]][:, None] + np.arange(wide)], w)
        one, two = where[: len(these)], where[len(these) :]
        most = (100 - percent) * (n[i[these]] + n[j[these]])
        for k in range(0, len(these), step := max(1, PAIRS // w)):
            apart = np.bitwise_count(cells[one[k : k + step]] ^ cells[two[k : k + step]]).sum(axis=1, dtype=np.int64)
            ok[these[k : k + step]] = (100 + percent) * apart <= most[k : k + step]
    return ok


def digests(docs: DataFrame, percent: int) -> DataFrame:
    """(doc_id, n, s, t, cells, sigs): size, hashes, histogram and signatures of each row's set."""

    def rows(batches):
        for batch in batches:
            for a, b in chunks(batch.column(1), CHUNK):
                sets = shingle_sets(batch.column(1).slice(a, b - a))
                ids = np.array([identity(x) for x in sets], np.int64).reshape(-1, 2)
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array([histogram(x) for x in sets], pa.binary()), packed_signatures(sets, 0, percent)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "s", "t", "cells", "sigs"])

    texts = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return texts.mapInArrow(tidy(rows), "doc_id long, n long, s long, t long, cells binary, sigs binary")


def packed_signatures(sets: list[np.ndarray], scheme: int, percent: int) -> pa.Array:
    """The first 48 bits of each signature."""
    return pa.array([np.ascontiguousarray(signatures(x, scheme, percent).view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes() for x in sets], pa.binary())


def signed_texts(docs: DataFrame, wanted: DataFrame, scheme: int, percent: int) -> DataFrame:
    """(s, sigs) of the wanted sets (s, low)."""

    def signed(texts):
        sets = shingle_sets(texts)
        return pa.RecordBatch.from_pydict({"s": pa.array([identity(x)[0] for x in sets], pa.int64()), "sigs": packed_signatures(sets, scheme, percent)})

    return of_texts(docs, wanted, signed, "s long, sigs binary").join(wanted.select("s"), "s", "left_semi")


def postings(signed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, sig, s) of (s, sigs): 32 bits of each signature in the bucket, and its sets, as blocks."""

    def blocks(sig, s):
        bucket = (((sig >> np.uint64(48)) * np.uint64(buckets)) >> np.uint64(16)).astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        bucket, sig, s = bucket[order], (sig >> np.uint64(16)).astype(np.uint32)[order], s[order]
        starts = np.flatnonzero(np.diff(bucket.astype(np.int32), prepend=-1))
        for k in range(0, len(starts), 4096):
            some = starts[k : k + 4096]
            end = starts[k + 4096] if k + 4096 < len(starts) else len(sig)
            part = slice(some[0], end)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[some].astype(np.int32)), packed(sig[part].view(np.uint8), 4 * (some - some[0])), packed(s[part].view(np.uint8), 8 * (some - some[0]))], names=["bucket", "sig", "s"])

    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for a, b in chunks(batch.column(1), 2 * CHUNK):
                raw, at = bytes_of(batch.column(1).slice(a, b - a))
                sig = np.zeros((len(raw) // 6, 8), np.uint8)
                sig[:, 2:] = raw.reshape(-1, 6)
                sig = sig.view(np.uint64).ravel()
                held.append((sig, np.repeat(batch.column(0).slice(a, b - a).to_numpy(), np.diff(at) // 6)))
                size += len(sig)
                if size >= BLOCK:
                    yield from blocks(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if size:
            yield from blocks(*map(np.concatenate, zip(*held)))

    return signed.select("s", "sigs").mapInArrow(tidy(rows), "bucket int, sig binary, s binary")


def lists(signed: DataFrame) -> DataFrame:
    """(members): the sets of (s, sigs) that share a signature, in order, 8 bytes each; the same sets once.  Saved.

    Other signatures of a bucket that agree in 32 bits count as the same.
    """
    total = (signed.agg(F.sum(F.octet_length("sigs"))).first()[0] or 0) // 6
    cut = postings(signed, min(1 << 16, max(BUCKETS, total >> TABLE_BITS)))

    def shared(parts):
        sig, s = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((s, sig))
        sig, s = sig[order], s[order]
        new = np.ones(len(s), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (s[1:] != s[:-1])
        sig, s = sig[new], s[new]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        sizes = np.diff(starts, append=len(sig))
        held = s[np.repeat(sizes > 1, sizes)]
        ends = np.cumsum(sizes[sizes > 1])
        return pa.RecordBatch.from_pydict({"members": packed(held.view(np.uint8), 8 * (ends - sizes[sizes > 1]))})

    def rows(batches):
        parts, now = [], None
        for batch in batches:
            starts, sizes = runs_of(bucket := batch.column(0).to_numpy()) if len(batch) else ((), ())
            for a, k in zip(starts, sizes):
                if parts and bucket[a] != now:
                    yield shared(parts)
                    parts = []
                now = bucket[a]
                sig, s = (np.frombuffer(bytes_of(batch.column(c).slice(a, k))[0].tobytes(), kind) for c, kind in ((1, np.uint32), (2, np.int64)))
                parts.append((sig, s))
        if parts:
            yield shared(parts)

    return saved(cut.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(rows), "members binary").distinct())


def tiles(met: DataFrame, limit: int, runs: bool) -> DataFrame:
    """(key, side, s): the members of lists (members) where they meet, across two sides or all on side 0.

    Members of lists of up to TILE all meet.  Longer ones are cut: with runs into runs, each with the
    list's first members, else, up to the limit, so that all meet.
    """

    def batch_of(key, side, s):
        return pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "side": pa.array(side, pa.int8()), "s": pa.array(s, pa.int64())})

    def rows(batches):
        for batch in batches:
            for a, b in chunks(batch.column(1), CHUNK):
                gid = np.ascontiguousarray(batch.column(0).slice(a, b - a).to_numpy()).view(np.uint64)
                raw, at = bytes_of(batch.column(1).slice(a, b - a))
                s, at = np.frombuffer(raw.tobytes(), np.int64), at // 8
                sizes = np.diff(at)
                short = sizes <= min(TILE, limit)
                some = s[np.repeat(short, sizes)]
                yield batch_of(np.repeat(gid[short], sizes[short]), np.zeros(len(some), np.int8), some)
                for k in np.flatnonzero(~short).tolist():
                    own = s[at[k] : at[k + 1]]
                    cut = [own[x : x + TILE] for x in range(0, len(own), TILE)]
                    if runs:
                        pairs = [(x, x) for x in range(len(cut))]
                    elif len(own) <= limit:
                        pairs = [(x, y) for x in range(len(cut)) for y in range(x, len(cut))]
                    else:
                        continue
                    for x, y in pairs:
                        meet = np.concatenate([cut[x], cut[y] if x < y else own[: PIVOTS if runs and x else 0]])
                        side = np.zeros(len(meet), np.int8)
                        side[len(cut[x]) :] = x < y
                        yield batch_of(np.repeat(mixed([gid[k : k + 1], *(np.array([z + 1], np.uint64) for z in (x, y))]), len(meet)), side, meet)

    return met.select(F.xxhash64("members"), "members").mapInArrow(tidy(rows), "key long, side byte, s long")


def meetings(met: DataFrame, sets: DataFrame, roots: DataFrame | None, percent: int, every: bool) -> DataFrame:
    """(u, v, nu, nv): pairs of the rows (key, side, s) of a key that may link, of different clusters; saved.

    Each row's pair with the first such row of its key, or with every one.  (u, null) tells
    a key u that has further ones.  Sets: (s, n, low, cells).
    """
    held = met.join(sets.select("s", "n", "cells"), "s")
    if roots is None:
        held = held.withColumn("root", F.col("s"))
    else:
        held = held.join(roots, held.s == roots.node, "left").withColumn("root", F.coalesce("root", "s"))
    held = held.select("key", "side", "s", "root", "n", "cells").repartition("key").sortWithinPartitions("key", "s")

    def pairs_of(starts, sizes, side):
        i, j, size = [], [], 0
        for m in np.unique(sizes[sizes > 1]).tolist():
            a, b = np.triu_indices(m, 1)
            for k in np.array_split(starts[sizes == m], -(-len(a) * int((sizes == m).sum()) // PAIRS)):
                one, two = (k[:, None] + a).ravel(), (k[:, None] + b).ravel()
                crossing = (side[one] != side[two]) | (side[one] == 2)
                i.append(one[crossing])
                j.append(two[crossing])
                size += len(one)
                if size >= PAIRS:
                    yield np.concatenate(i), np.concatenate(j)
                    i, j, size = [], [], 0
        if size:
            yield np.concatenate(i), np.concatenate(j)

    def work(keyed):
        key, side, s, root, n = (keyed.column(k).to_numpy() for k in range(5))
        raw, at = bytes_of(keyed.column(5))
        raw, at = np.frombuffer(raw.tobytes(), np.uint64), at // 8
        starts, sizes = runs_of(key)
        tile = np.repeat(np.arange(len(starts)), sizes)
        whole = np.add.reduceat(side.astype(np.int64), starts) == 0
        side = np.where(whole[tile], 2, side)
        for i, j in pairs_of(starts, sizes, side):
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            ok = may_link(raw, at, n, i, j, percent)
            i, j = i[ok], j[ok]
            if not every:
                order = np.lexsort((i, j))
                i, j = i[order], j[order]
                first = np.append(True, j[1:] != j[:-1])[: len(j)]
                more = np.unique(key[i[~first]])
                i, j = i[first], j[first]
                yield pa.RecordBatch.from_pydict({"u": pa.array(more), "v": pa.nulls(len(more), pa.int64()), "nu": pa.nulls(len(more), pa.int64()), "nv": pa.nulls(len(more), pa.int64())})
            swap = s[i] < s[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield pa.RecordBatch.from_pydict({"u": pa.array(s[i]), "v": pa.array(s[j]), "nu": pa.array(n[i]), "nv": pa.array(n[j])})

    def found(batches):
        rest = None
        for batch in batches:
            if not len(batch):
                continue
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = batch.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut:
                yield from work(batch.slice(0, cut))
            rest = batch.slice(cut)
        if rest is not None:
            yield from work(rest)

    def rows(batches):
        made, size = [], 0
        for batch in found(batches):
            made.append(batch)
            size += len(batch)
            if size >= PAIRS:  # pairs that lists of a task have in common are one
                made = once(made)
                if (size := sum(map(len, made))) >= PAIRS // 2:
                    yield from made
                    made, size = [], 0
        yield from once(made)

    def once(made):
        return pa.Table.from_batches(made).group_by(["u", "v", "nu", "nv"]).aggregate([]).to_batches() if made else []

    return saved(held.mapInArrow(tidy(rows), "u long, v long, nu long, nv long").distinct())


def able(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v, nu, nv): the distinct pairs that may link by their sizes and sketches; sets: (s, n, low, cells)."""
    side = lambda key: sets.select(F.col("s").alias(key), F.col("n").alias(f"n{key}"), F.col("cells").alias(f"c{key}"))
    both = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().join(side("u"), "u").join(side("v"), "v")
    both = both.filter(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv"))

    def rows(batches):
        for batch in batches:
            n = batch.column("nu").to_numpy() + batch.column("nv").to_numpy()
            apart = np.array([cells_apart(a.as_py(), b.as_py()) for a, b in zip(batch.column("cu"), batch.column("cv"))], np.int64)
            kept = np.flatnonzero((100 + percent) * apart <= (100 - percent) * n)
            yield batch.select(["u", "v", "nu", "nv"]).take(pa.array(kept, pa.int64()))

    return saved(both.mapInArrow(tidy(rows), "u long, v long, nu long, nv long"))


def verified(some: DataFrame, docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of sets that link, of (u, v, nu, nv); sets: (s, n, low, cells)."""
    first = len(MADE)
    wanted = sets.join(some.select(F.col("u").alias("s")).union(some.select("v")).distinct(), "s").select("s", "low")
    elements = elements_of(docs, saved(wanted))
    both = some.join(elements.select(F.col("s").alias("u"), F.col("x").alias("a")), "u").join(elements.select(F.col("s").alias("v"), F.col("x").alias("b")), "v")
    same = F.size(F.array_intersect("a", "b")).cast("long")
    linked = saved(both.select("u", "v", "nu", "nv", same.alias("same")).filter(100 * F.col("same") >= percent * (F.col("nu") + F.col("nv") - F.col("same"))).select("u", "v"))
    clear(docs.sparkSession, first, last_made())
    return linked


def elements_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(s, x) of the sets (s, low) that are wanted, from the text of document low."""

    def sets_of(texts):
        sets = shingle_sets(texts)
        return pa.RecordBatch.from_pydict({"s": pa.array([identity(x)[0] for x in sets], pa.int64()), "x": pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))})

    found = of_texts(docs, wanted, sets_of, "s long, x array<long>")
    return saved(found.join(wanted.select("s"), "s", "left_semi").dropDuplicates(["s"]))


def wanted_table(wanted: DataFrame) -> np.ndarray:
    """Bits set at the documents of (s, low): at most 2^WANTED_BITS of them reach the driver, 64 in a row."""
    bucket = F.shiftrightunsigned(F.xxhash64("low"), 64 - WANTED_BITS)
    slots = wanted.select(F.shiftright(bucket, 6).alias("slot"), F.expr("shiftleft(1L, cast(%s & 63 as int))" % f"shiftrightunsigned(xxhash64(low), {64 - WANTED_BITS})").alias("bits"))
    found = slots.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (WANTED_BITS - 6), np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def of_texts(docs: DataFrame, wanted: DataFrame, made, schema: str) -> DataFrame:
    """What made gives for arrays of the texts of the documents that stand for the wanted sets (s, low), and for a few others.

    The table of wanted documents goes to the tasks, so texts are not shuffled.
    """
    table = docs.sparkSession.sparkContext.broadcast(wanted_table(wanted))

    def rows(batches):
        for batch in batches:
            bucket = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint64) >> np.uint64(64 - WANTED_BITS)
            texts = batch.column(1).filter(pa.array(is_set(table.value, bucket.astype(np.int64))))
            for a, b in chunks(texts, CHUNK):
                yield made(texts.slice(a, b - a))

    return docs.select(F.xxhash64(F.col("doc_id").cast("long")), whole_text().alias("text")).mapInArrow(tidy(rows), schema)


def members_of(met: DataFrame) -> DataFrame:
    """(sig, s) of the members of lists."""

    def rows(batches):
        for batch in batches:
            for a, b in chunks(batch.column(1), CHUNK):
                raw, at = bytes_of(batch.column(1).slice(a, b - a))
                sig = np.repeat(batch.column(0).slice(a, b - a).to_numpy(), np.diff(at) // 8)
                yield pa.RecordBatch.from_pydict({"sig": pa.array(sig), "s": pa.array(np.frombuffer(raw.tobytes(), np.int64))})

    return met.select(F.xxhash64("members"), "members").mapInArrow(tidy(rows), "sig long, s long")


def clustered(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(sig, s, root): the members of groups with their clusters, of the groups that hold several."""
    placed = met.join(roots, met.s == roots.node, "left").select("sig", "s", F.coalesce("root", "s").alias("root"))
    several = placed.groupBy("sig").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("sig")
    return saved(placed.join(several, "sig"))


def links(docs: DataFrame, signed: DataFrame, sets: DataFrame, percent: int = PERCENT, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(links between sets that make all components, the root of each linked set); signed: (s, sigs), sets: (s, n, low, cells)."""
    found, roots, limit = [], None, DIRECT * crowd
    size = F.octet_length("members") / 8
    for scheme in range(len(SCHEMES)):
        met = lists(signed)
        tried, again, some = [], None, tiles(met, limit, True)
        for k in range(ROUNDS + 1):
            if k == ROUNDS:
                some = tiles(met.filter(size <= TILE), limit, False).join(again, "key", "left_semi").union(tiles(met.filter(size > TILE), limit, False))
            pairs = meetings(some, sets, roots, percent, k == ROUNDS)
            again = pairs.filter("v is null").select(F.col("u").alias("key"))
            pairs = pairs.filter("v is not null")
            for before in tried:
                pairs = pairs.join(before.select("u", "v"), ["u", "v"], "left_anti")
            tried.append(pairs)
            found.append(verified(pairs, docs, sets, percent))
            roots = components(found[-1] if roots is None else found[-1].union(roots))
        if not met.filter(size > limit).limit(1).count():
            break
        held = clustered(members_of(met.filter(size > limit)), roots)
        clusters = held.groupBy("sig", "root").agg(F.count("*").alias("c")).groupBy("sig").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("q"))
        held = saved(held.join(clusters.select("sig", ((F.col("n") * F.col("n") - F.col("q")) > 2 * crowd * F.col("n")).alias("crowded")), "sig"))
        last = scheme == len(SCHEMES) - 1
        fit = held if last else held.filter("not crowded")
        one, two = fit.select("sig", F.col("s").alias("u"), F.col("root").alias("ru")), fit.select("sig", F.col("s").alias("v"), F.col("root").alias("rv"))
        found.append(verified(able(one.join(two, "sig").filter("u > v and ru <> rv").select("u", "v"), sets, percent), docs, sets, percent))
        roots = components(found[-1].union(roots))
        if last:
            break
        crowded = saved(held.filter("crowded").select("s").distinct().join(sets, "s").select("s", "low"))
        if not crowded.limit(1).count():
            break
        signed = saved(signed_texts(docs, crowded, scheme + 1, percent))
    return reduce(DataFrame.union, found), roots


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of (doc_id, text): the smallest doc_id reachable over links.

    Null and empty texts, and texts without words, have no shingles and are linked with
    nothing: their component is their own doc_id.  Rows of one doc_id stay rows; a null
    doc_id counts only if its component has no other.  An empty table gives no rows,
    texts may be of any length, other columns are not looked at.
    """
    rows = saved(digests(docs, percent))
    classes = saved(rows.filter("n > 0").groupBy("s", "t", "n", "cells").agg(F.min("doc_id").alias("low")))
    _, roots = links(docs, rows.filter("n > 0").select("s", "sigs"), classes, percent)
    rooted = classes.join(roots, classes.s == roots.node, "left").select("s", "t", "low", F.coalesce("root", "s").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = rooted.join(lowest, "root").select("s", "t", "component_id")
    out = rows.filter("n > 0").join(of_class, ["s", "t"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.filter("n = 0").select("doc_id", "n", "doc_id"))


#: DuckDB SQL for what the query returns: pairs that share a shingle, and the components by repeated minima.
SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [ws] ELSE [ws[i : i + {SHINGLE - 1}] for i in range(1, len(ws) - {SHINGLE - 2})] END) AS x FROM w),
h AS (SELECT doc_id, md5_number(array_to_string(x, ' ')) AS x FROM s),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS same FROM h a JOIN h b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * same >= {PERCENT} * (x.n + y.n - same)),
r AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.low, w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN (SELECT u, min(v) AS low FROM r GROUP BY u) c ON c.u = w.doc_id
"""
