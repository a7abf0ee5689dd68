"""Repeated runs of lines, found with a suffix array over line ids (operator 9).

A document is the sequence of its lines that hold a word.  A run of lines counts
as a later copy if the same lines, with at least ``min_words`` words, start at an
earlier place of the corpus (smaller doc_id, then text hash, then line number);
every line of a later copy is deleted, with the blank lines inside it.

1. Lines that occur once break the sequences into segments of repeated lines.
   A segment that equals an earlier one as a whole is a later copy as a whole,
   so only the first of each goes on, however many copies there are.
2. Prefix doubling ranks the suffixes of these segments: each round sorts the
   pairs (rank, rank 2^k lines on) over the cluster and numbers them densely.
   Runs are the union of runs that start at each of their lines and end at most
   ``min_words`` words behind it, so ranks of that many lines suffice, which
   bounds both the rounds and the line ids that a suffix carries.
3. In suffix order, longest common prefixes with the neighbours form intervals;
   a stack over them yields for each suffix its longest earlier copy.  The order is
   cut into ranges of equal size, whatever prefixes they share.  Each range says what
   its ends hold (for each length the earliest place with so long a common prefix);
   these few values, passed on from range to range, stand for all suffixes outside.

Lines go by a 64-bit hash.  Where lines of one hash differ in a second one, both
together make their hash, so lines count as equal only if 128 bits are.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, last_made, saved, tidy, unused, whole_text

MIN_WORDS = 50
#: Bits of the first hash; fewer in tests.
HASH_BITS = 64
KEY = ["doc_id", "th"]


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the text and its hash: rows alike in both are one document here, and are treated alike."""
    return docs.select("doc_id", F.xxhash64(whole_text()).alias("th"), whole_text().alias("text"), *more)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, at, line, h, other, words) of every line with a word: at counts those lines, line all lines; h and other are hashes."""
    bits = HASH_BITS

    def rows(batches):
        import xxhash

        digest = xxhash.xxh64_intdigest
        for batch in batches:
            doc, th = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = [[] for _ in range(7)]
            for d, t, text in zip(doc, th, batch.column(2)):
                at = 0
                for k, line in enumerate(text.as_py().encode().split(b"\n")):
                    n = len(line.split())
                    if n:
                        for column, x in zip(out, (d, t, at, k, (digest(line) >> (64 - bits)) - (1 << 63), digest(line, 1) - (1 << 63), n)):
                            column.append(x)
                        at += 1
                if len(out[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)
                    out = [[] for _ in range(7)]
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("at", pa.int32()), ("line", pa.int32()), ("h", pa.int64()), ("other", pa.int64()), ("words", pa.int32())])
    return docs.mapInArrow(tidy(rows), "doc_id long, th long, at int, line int, h long, other long, words int")


def with_counted(df: DataFrame, key: str, counts: DataFrame, total: int, how: str) -> DataFrame:
    """df joined with counts (key, n and more), which is saved, and n left out.

    Keys that make up a ten-thousandth of the total or more are at most ten thousand;
    they are broadcast, so that no key gathers its rows in one task.
    """
    hot = max(1000, total // 10_000)
    often = F.broadcast(counts.filter(F.col("n") >= hot).drop("n"))
    usual = counts.filter(F.col("n") < hot).drop("n")
    rest = df.join(F.broadcast(counts.filter(F.col("n") >= hot).select(key)), key, "left_anti")
    return df.join(often, key, how).unionByName(rest.join(usual, key, how))


def repeated_lines(found: DataFrame) -> DataFrame:
    """The rows whose line occurs twice or more, without their second hash."""

    def counted(rows: DataFrame) -> DataFrame:
        return saved(rows.groupBy("h").agg(F.count("*").alias("n"), F.min("other").alias("a"), F.max("other").alias("b")).filter("n > 1"))

    counts = counted(found)
    if counts.filter("a <> b").limit(1).count():
        shared = counts.filter("a <> b").select(F.col("h").alias("shared"))
        both = F.when(F.col("shared").isNull(), F.col("h")).otherwise(F.xxhash64("h", "other"))
        found = saved(found.join(shared, F.col("h") == F.col("shared"), "left").withColumn("h", both).drop("shared"))
        counts = counted(found)
    return with_counted(found, "h", counts.select("h", "n"), found.count(), "left_semi").drop("other")


def segments(found: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, start, hs, ws, ls): maximal runs of repeated lines with min_words or more."""
    seat = Window.partitionBy(*KEY).orderBy("at")
    runs = repeated_lines(found).withColumn("run", F.col("at") - F.row_number().over(seat))
    whole = runs.groupBy(*KEY, "run").agg(F.array_sort(F.collect_list(F.struct("at", "line", "h", "words"))).alias("x"), F.sum("words").alias("n"))
    return whole.filter(F.col("n") >= min_words).select(*KEY, F.col("x.at")[0].alias("start"), F.col("x.h").alias("hs"), F.col("x.words").alias("ws"), F.col("x.line").alias("ls"))


def dense_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """columns and rank, for each distinct row of columns, numbered in their order without gaps."""

    def number(batches):
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(k, k + n), pa.int64())], names=[*columns, "part", "k"])
            k += n

    dealt = df.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns)
    numbered = saved(dealt.mapInArrow(tidy(number), ", ".join(f"{c} long" for c in columns) + ", part long, k long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = numbered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return numbered.join(base, "part").select(*columns, (F.col("base") + F.col("k")).alias("rank"))


def suffix_ranks(first: DataFrame, reach: int) -> DataFrame:
    """(doc_id, th, start, off, rank): order of the suffixes of all segments by their next reach lines or more."""
    of = ["doc_id", "th", "start"]
    rows = first.select(*of, F.posexplode("hs").alias("off", "h"))
    ranks = dense_ranks(rows, ["h"])
    now, spark = saved(rows.join(ranks, "h").select(*of, "off", "rank")), first.sparkSession
    total, distinct, width, held = now.count(), ranks.count(), 1, [last_made()]
    while width < reach and distinct < total:
        on = Window.partitionBy(*of).orderBy("off")
        pairs = now.withColumn("next", F.coalesce(F.lead("rank", width).over(on), F.lit(-1).cast("long"))).withColumnRenamed("rank", "r")
        pairs = saved(pairs)
        drop(spark, *held)
        held = [last_made()]
        ranks = dense_ranks(pairs, ["r", "next"])
        held.append(last_made())
        now = saved(pairs.join(ranks, ["r", "next"]).select(*of, "off", "rank"))
        distinct, width = ranks.count(), width * 2
        drop(spark, *held)
        held = [last_made()]
    return now


def suffixes(first: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, start, off, least, ahead, line, last) of each suffix with min_words words.

    least: lines up to min_words words; ahead: the line ids that matter, least of
    the next suffix and one more; lines: their numbers in the text.
    """

    def rows(batches):
        for batch in batches:
            columns = batch.to_pydict()
            out: dict[str, list] = {name: [] for name in schema.names}
            for d, t, s, hs, ws, ls in zip(*(columns[c] for c in ("doc_id", "th", "start", "hs", "ws", "ls"))):
                sums = np.concatenate([[0], np.cumsum(ws)])
                n = len(ws)
                least = np.searchsorted(sums, sums[:-1] + min_words)  # end of the shortest run, n + 1 if none
                for off in range(n):
                    if least[off] > n:
                        break
                    end = min(n, int(least[off + 1]) if off + 1 < n else n)
                    for name, x in zip(schema.names, (d, t, s, off, int(least[off]) - off, hs[off:end], ls[off:end])):
                        out[name].append(x)
                if len(out["off"]) > 20_000:
                    yield pa.RecordBatch.from_pydict(out, schema)
                    out = {name: [] for name in schema.names}
            if out["off"]:
                yield pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("off", pa.int32()), ("least", pa.int32()), ("ahead", pa.list_(pa.int64())), ("ls", pa.list_(pa.int32()))])
    return first.mapInArrow(tidy(rows), "doc_id long, th long, start int, off int, least int, ahead array<long>, ls array<int>")


def longest_earlier(items: list[tuple], common: list[int]) -> list[int]:
    """For places in suffix order, common[k] the common prefix of k-1 and k: the longest with any smaller place."""
    best = [0] * len(items)
    stack: list[tuple[int, int]] = []  # (item, common prefix with the smaller place on its left)
    for k, place in enumerate(items):
        run = common[k] if k else 0
        while stack and items[stack[-1][0]] > place:
            top, left = stack.pop()
            best[top] = max(left, run)
            run = min(run, left)
        stack.append((k, run if stack else 0))
    for top, left in stack:
        best[top] = max(best[top], left)
    return best


def prefix_length(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def staircase(steps: list[tuple[int, tuple]], most: int) -> list[tuple[int, tuple]]:
    """(length, place), lengths rising: those that no step of the same length or longer beats, with lengths cut to most."""
    out: list[tuple[int, tuple]] = []
    for length, place in sorted(((min(n, most), p) for n, p in steps), key=lambda x: (-x[0], x[1])):
        if length and (not out or place < out[-1][1]):
            out.append((length, place))
    return out[::-1]


ENDLESS = 1 << 30


class Ends:
    """What a range of suffixes in order shows to those before and behind it."""

    def __init__(self):
        self.first = self.last = None
        self.least = ENDLESS  # of all common prefixes inside
        self.front: list[tuple[int, tuple]] = []
        self.back: list[tuple[int, tuple]] = []

    def add(self, place: tuple, ahead: list) -> int:
        """The next suffix; returns its common prefix with the one before."""
        common = ENDLESS if self.first is None else prefix_length(self.last, ahead)
        if self.first is None:
            self.first = ahead
        elif common < self.least:
            self.least = common
        if self.least and (not self.front or place < self.front[-1][1]):
            self.front.append((self.least, place))
        back = self.back if not self.back or self.back[-1][0] <= common else staircase(self.back, common)
        while back and back[-1][1] >= place:
            back.pop()
        self.back = [*back, (ENDLESS, place)]
        self.last = ahead
        return 0 if common == ENDLESS else common


def carried(ends: dict[int, Ends]) -> dict[int, tuple[list, list]]:
    """For each range the steps of all suffixes before it, and of all behind it."""
    order = sorted(ends)
    before: dict[int, list] = {}
    behind: dict[int, list] = {}
    for way, out in ((order, before), (order[::-1], behind)):
        steps: list[tuple[int, tuple]] = []
        last = None
        for k in way:
            e = ends[k]
            near, far, own = (e.first, e.last, e.back) if way is order else (e.last, e.first, e.front)
            steps = staircase(steps, prefix_length(last, near)) if last is not None else []
            out[k] = steps
            steps = staircase([*own, *staircase(steps, e.least)], ENDLESS)
            last = far
    return {k: (before[k], behind[k]) for k in order}


def place_of(row: dict) -> tuple:
    return (int(row["doc_id"] is not None), row["doc_id"] or 0, row["th"], row["start"] + row["off"])


def later_copies(ranked: DataFrame) -> DataFrame:
    """(doc_id, th, first, last): line numbers of later copies, from suffixes with their ranks."""
    order = ["rank", *KEY, "start", "off"]
    columns = ["doc_id", "th", "start", "off", "least", "ahead", "ls"]

    def numbered(batches):
        part, k, ends, schema = TaskContext.get().partitionId(), 0, Ends(), None
        for batch in batches:
            n = batch.num_rows
            for row in batch.select(["doc_id", "th", "start", "off", "ahead"]).to_pylist():
                ends.add(place_of(row), row["ahead"])
            extra = [pa.array(np.full(n, part), pa.int64()), pa.array(np.arange(k, k + n)), pa.nulls(n, pa.string())]
            out = pa.RecordBatch.from_arrays([*batch.select(columns).columns, *extra], names=[*columns, "part", "k", "ends"])
            schema = out.schema
            yield out
            k += n
        if k:
            shown = json.dumps([ends.first, ends.last, ends.least, ends.front, ends.back])
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, schema.field(c).type) for c in columns), pa.array([part], pa.int64()), pa.array([-1], pa.int64()), pa.array([shown])], schema=schema)

    kinds = "doc_id long, th long, start int, off int, least int, ahead array<long>, ls array<int>"
    sorted_rows = saved(ranked.select(*columns, "rank").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidy(numbered), f"{kinds}, part long, k long, ends string"))
    ends = {}
    steps = lambda x: [(n, tuple(p)) for n, p in x]
    for r in sorted_rows.filter("k = -1").select("part", "ends").collect():  # a row for each range
        e = ends[r["part"]] = Ends()
        first, last, least, front, back = json.loads(r["ends"])
        e.first, e.last, e.least, e.front, e.back = first, last, least, steps(front), steps(back)
    outside = ranked.sparkSession.sparkContext.broadcast(carried(ends))

    def rows(batches):
        group, part = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if group:
                        yield solve(group, part)
                    group, part = [], row["part"]
                group.append(row)
        if group:
            yield solve(group, part)

    def solve(group, part):
        before, behind = outside.value[part]
        # steps stand as suffixes of their own, the nearest with the longest common prefix
        places = [p for _, p in before] + [place_of(r) for r in group] + [p for _, p in behind[::-1]]
        common = [0] + [n for n, _ in before] + [prefix_length(a["ahead"], b["ahead"]) for a, b in zip(group, group[1:])] + [n for n, _ in behind[::-1]]
        out: dict[str, list] = {name: [] for name in schema.names}
        for r, n in zip(group, longest_earlier(places, common)[len(before) :]):
            if n >= r["least"]:
                for name, x in zip(schema.names, (r["doc_id"], r["th"], r["ls"][0], r["ls"][n - 1])):
                    out[name].append(x)
        return pa.RecordBatch.from_pydict(out, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])
    dealt = sorted_rows.filter("k >= 0").drop("ends").repartition("part").sortWithinPartitions("part", "k")
    return dealt.mapInArrow(tidy(rows), "doc_id long, th long, first int, last int")


def runs_to_delete(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, th, first, last): line numbers, both included, of every later copy in (doc_id, text)."""
    of = ["doc_id", "th", "start"]
    found = saved(lines(keyed(docs)))
    found = found.dropDuplicates([*KEY, "at"])
    whole = saved(segments(found, min_words).withColumn("content", F.sha2(F.concat_ws(",", F.transform("hs", lambda h: h.cast("string"))), 256)))
    earliest = F.min(F.struct(*of))
    firsts = whole.groupBy("content").agg(earliest.alias("f"), F.count("*").alias("n"))
    firsts = saved(firsts.select("content", "n", *[F.col(f"f.{c}").alias(f"first_{c}") for c in of]))
    same = [F.col(c).eqNullSafe(F.col(f"first_{c}")) for c in of]
    both = saved(with_counted(whole, "content", firsts, whole.count(), "inner").withColumn("is_first", same[0] & same[1] & same[2]).drop("content", *[f"first_{c}" for c in of]))
    copies = both.filter("not is_first").select(*KEY, F.col("ls")[0].alias("first"), F.element_at("ls", -1).alias("last"))
    first = both.filter("is_first")
    parts = saved(suffixes(first, min_words))
    reach = parts.agg(F.max(F.size("ahead"))).first()[0] or 0
    ranks = suffix_ranks(first, reach)
    same = [parts[c].eqNullSafe(ranks[c]) for c in [*of, "off"]]
    ranked = parts.join(ranks, same[0] & same[1] & same[2] & same[3]).select(*[parts[c] for c in parts.columns], "rank")
    return copies.union(later_copies(ranked))


def without_lines(text: str, runs: list[dict]) -> str:
    rows = text.split("\n")
    gone = bytearray(len(rows))
    for r in runs:
        gone[r["first"] : r["last"] + 1] = b"\1" * (r["last"] + 1 - r["first"])
    return "\n".join(x for x, g in zip(rows, gone) if not g)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, made: tuple[str, str] = ("n_lines", "n_deleted")) -> DataFrame:
    """The rows of docs, their other columns as they are, with n_lines and n_deleted and the text without later copies.

    Texts are split at newlines and may be of any length.  A null text stays null;
    an empty one has no line.  All rows of docs stay, also those that lose every
    line; rows alike in doc_id and text are one document and come out alike, as many
    as they were.  An empty table gives no rows.  made names the two
    columns; columns of docs so named give way.
    """
    names = [c for c in docs.columns if c not in made]
    runs = runs_to_delete(docs, min_words).groupBy(*KEY).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    of_id, of_text, of_runs = (unused(docs, f"sluice_{x}") for x in ("id", "th", "runs"))
    runs = runs.select(F.col("doc_id").alias(of_id), F.col("th").alias(of_text), F.col("runs").alias(of_runs))
    same = F.col("doc_id").eqNullSafe(F.col(of_id)) & (F.xxhash64(whole_text()) == F.col(of_text))
    joined = docs.select(*[f"`{c}`" for c in names]).join(runs, same, "left")

    def cut(batches):
        for batch in batches:
            old = batch.column("text").to_pylist()
            texts = [t if not r else without_lines(t, r) for t, r in zip(old, batch.column(of_runs).to_pylist())]
            n, left = ([t.count("\n") + 1 if t else 0 for t in x] for x in (old, texts))
            columns = {f: batch.column(f) for f in names} | {"text": pa.array(texts, pa.string())}
            columns |= {made[0]: pa.array(n, pa.int64()), made[1]: pa.array([a - b for a, b in zip(n, left)], pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return joined.select(*[f"`{c}`" for c in names], of_runs).mapInArrow(tidy(cut), f"{kinds}, {made[0]} long, {made[1]} long")
