"""Hierarchical packing of documents into windows of several sizes (operator 3).

Every document is cut into full long windows and a rest; rests are routed to the
smallest tier (512, 1024, 2048 or 4096 ids) that holds them.  From the longest
tier down, each window takes one rest of its tier and fills its gap with the
largest rests of shorter tiers that fit, at last with a cut piece, so windows
come out exactly full.  Windows are dealt into step groups of equal token sums.

Each task packs what it reads, block after block; unfinished rests move on to the
next block, and what is left at a task's end is cut into windows of smaller powers
of two.  So nothing is padded or shuffled, no key matters, and memory is bounded
by a block.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import tidy, whole_text
from .tokens import encoded, encoder

TIERS = (512, 1024, 2048, 4096)
#: Ids that a task holds before it packs them.
BLOCK_IDS = 3_000_000
#: Ids of a step group, as near as whole windows allow.
STEP_IDS = 64 * 4096
#: Encoded pieces that a worker keeps where memory allows: some 100 bytes each.
MANY_PIECES = 600_000


def pack(lengths: list[int], pool: list[tuple[int, int, int]], last: bool, tiers: tuple[int, ...] = TIERS):
    """Windows from documents of these lengths and the rests (length, document, start) of before.

    Returns windows (size, [(document, start, length)]) and the rests that wait
    for more; with last, all is placed.
    """
    top = tiers[-1]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    rests = list(pool)
    for d, n in enumerate(lengths):
        full = n // top
        windows += [(top, [(d, k * top, top)]) for k in range(full)]
        if n % top:
            rests.append((n % top, d, full * top))
    rests.sort()
    for size in reversed(tiers):
        lower = max([t for t in tiers if t < size], default=0)
        while rests and rests[-1][0] > lower:
            n, d, start = rests.pop()
            pieces, gap = [(d, start, n)], size - n
            while gap and (k := bisect_right(rests, (gap, 1 << 62, 0))):
                n, d, start = rests.pop(k - 1)
                pieces.append((d, start, n))
                gap -= n
            if gap and rests:
                n, d, start = rests.pop()
                pieces.append((d, start, gap))
                insort(rests, (n - gap, d, start + gap))
                gap = 0
            if gap:
                # no more rests: all of this window waits, or ends short
                if last:
                    return windows + powers_of_two(pieces), []
                return windows, [(n, d, start) for d, start, n in pieces]
            windows.append((size, pieces))
    return windows, rests


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of falling powers of two that hold a task's last pieces without padding."""
    windows, todo = [], list(pieces)
    while todo:
        size = 1 << (sum(n for _, _, n in todo).bit_length() - 1)
        window, gap = [], size
        while gap:
            d, start, n = todo.pop(0)
            window.append((d, start, min(n, gap)))
            if n > gap:
                todo.insert(0, (d, start + gap, n - gap))
            gap -= min(n, gap)
        windows.append((size, window))
    return windows


def step_groups(sizes: list[int], step: int = STEP_IDS) -> list[int]:
    """Deal windows into groups with token sums as equal as can be: largest first, to the lightest."""
    heap = [(0, g) for g in range(max(1, -(-sum(sizes) // step)))]
    out = [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        total, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (total + sizes[k], g))
    return out


SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("window", pa.int64()), ("step_group", pa.int64()), ("ids", pa.binary())])


def pack_documents(docs: DataFrame, tokenizer: str, pieces: str, end_id: int, tiers: tuple[int, ...] = TIERS, block_ids: int = BLOCK_IDS, limit: int | None = None) -> DataFrame:
    """Pieces of all (doc_id, text): doc_id, start, length, doc_tokens, sequence_id, offset, window, step_group, ids.

    ids are little-endian unsigned 32-bit.  A null text is an empty one: its one
    id is end_id.  Repeated rows are documents of their own; an empty table gives
    no piece.  Numbers of sequences and groups have the task in the upper bits.
    limit: encoded pieces of text that a worker keeps.
    """

    def packed(batches):
        width = encoder(tokenizer, pieces, limit=limit).dtype
        task = TaskContext.get().partitionId() << 36
        counts = {"window": 0, "group": 0}
        held: list[tuple[int | None, bytes]] = []
        pool: list[tuple[int, int, int]] = []
        fresh = size = 0

        def flush(last: bool):
            nonlocal held, pool, fresh, size
            n = width.itemsize
            old = len(held) - fresh
            # pool has places in held; new documents come after the old ones
            lengths = [0] * old + [len(ids) // n for _, ids in held[old:]]
            windows, pool = pack(lengths, pool, last, tiers)
            groups = step_groups([s for s, _ in windows])
            columns: dict[str, list] = {name: [] for name in SCHEMA.names}
            for (window, found), group in zip(windows, groups):
                offset = 0
                for d, start, length in found:
                    key, ids = held[d]
                    raw = memoryview(ids)[start * n : (start + length) * n]
                    row = (key, start, length, len(ids) // n, task + counts["window"], offset, window, task + counts["group"] + group, np_ids(raw, width))
                    for name, value in zip(SCHEMA.names, row):
                        columns[name].append(value)
                    offset += length
                counts["window"] += 1
            counts["group"] += max(groups, default=-1) + 1
            keep = sorted({d for _, d, _ in pool})
            place = {d: k for k, d in enumerate(keep)}
            held, pool = [held[d] for d in keep], [(m, place[d], start) for m, d, start in pool]
            fresh = size = 0
            return pa.RecordBatch.from_pydict(columns, SCHEMA)

        for key, ids in encoded(batches, tokenizer, pieces, end_id, chars=3_000_000, limit=limit):
            held.append((key, ids))
            fresh += 1
            size += len(ids) // width.itemsize
            if size >= block_ids:
                yield flush(False)
        if held:
            yield flush(True)

    names = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, window long, step_group long, ids binary"
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(tidy(packed), names)


def np_ids(raw, dtype) -> bytes:
    import numpy as np

    return np.frombuffer(raw, dtype).astype("<u4").tobytes()
