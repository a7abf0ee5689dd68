"""Scoring of whole documents by a gated recurrent language model (operator 4).

Spark counts every word of all training documents.  The most frequent words, KNOWN
at most (a fixed bound), go to all executors; the counts of the others stay a table
and are joined where a document uses them.  Each text is turned into the model's
units once.  The recurrent model learns from all training documents in ROUNDS: each
task trains a copy by truncated backpropagation over its share, state carried through
whole documents and gradients taken over every window, and the copies are averaged.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import saved, tidy, whole_text
from .words import chunks, split_words

FOLDS, HELD = 5, 1
#: Words that are units of their own; words whose counts executors hold; training rounds and folds of each.
SHORT, KNOWN = 2048, 150_000
ROUNDS = ((0, 2), (3, 4))
#: Groups in which the tasks' copies are averaged first, so that no task gets one from every other.
SLOTS = 64
#: Bytes of text that a task encodes at once, and tokens that it gathers before it scores or trains on them.
CHUNK, BUFFER = 5_000_000, 1_500_000
SHAPES = 25
MARKS = (set("äöüß"), set("ñíóáú"), set("éèêçàùâîôû"))
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def fold(doc_id) -> int:
    """crc32 of the doc_id as text, modulo FOLDS; a null doc_id has an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def shape(word: bytes) -> int:
    """A class for rarer words: letters with marks, what they end in, and whether they are long."""
    if any(48 <= x < 58 for x in word):
        return 24
    last = word[-1:]
    ending = 0 if last.isalpha() or last > b"\x7f" else 1 if last in (b".", b",") else 2
    mark = 0
    if not word.isascii():
        text = word.decode()
        mark = next((k for k, s in enumerate(MARKS, 1) if not s.isdisjoint(text)), 0)
    return (mark * 3 + ending) * 2 + (len(word) > 6)


#: By the second byte of a letter with a mark (the first is C3): a bit for each set of MARKS.
MARK_BITS = np.zeros(256, np.uint8)
for _k, _set in enumerate(MARKS):
    MARK_BITS[[c.encode()[1] for c in sorted(_set)]] |= 1 << _k
#: The number of the first set among those bits.
FIRST_MARK = np.array([0, 1, 2, 1, 3, 1, 2, 1])


def shapes_of(words: list[bytes]) -> np.ndarray:
    """The shapes of many words at once."""
    if len(words) < 12 or b"" in words:
        return np.array([shape(w) for w in words], np.int64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(sizes)
    starts, last = ends - sizes, data[ends - 1]
    letter = (last | 32) - 97 < 26  # unsigned: other bytes wrap around to large ones
    ending = np.where(letter | (last > 127), 0, np.where((last == 46) | (last == 44), 1, 2))
    bits = np.zeros(len(data), np.uint8)
    at = np.flatnonzero(data[:-1] == 0xC3)
    bits[at] = MARK_BITS[data[at + 1]]
    mark = FIRST_MARK[np.bitwise_or.reduceat(bits, starts)]
    out = (mark * 3 + ending) * 2 + (sizes > 6)
    out[np.logical_or.reduceat(data - 48 < 10, starts)] = 24
    return out


def rare_units(words: list[bytes]) -> np.ndarray:
    """The units, from 0 on, of words that have none of their own: by shape, then by the last letters."""
    ends = np.fromiter((zlib.crc32(w.rstrip(PUNCTUATION)[-2:]) % gru.SIZE for w in words), np.int64, len(words))
    return shapes_of(words) * gru.SIZE + ends


def texts_of(batches):
    """(doc_ids, texts) of runs of rows (doc_id, text) of about CHUNK bytes."""
    for batch in batches:
        for a, b in chunks(batch.column(1), CHUNK):
            yield batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over the training documents, the end as the empty word."""

    def rows(batches):
        held, size = [], 0

        def merged():
            words = pa.chunked_array([w for w, _ in held]).combine_chunks().dictionary_encode()
            n = np.bincount(words.indices.to_numpy(zero_copy_only=False), np.concatenate([x for _, x in held]), len(words.dictionary))
            return words.dictionary, n.astype(np.int64)

        for keys, texts in texts_of(batches):
            learned = np.array([fold(k) != HELD for k in keys.to_pylist()])
            if learned.any():
                words = split_words(texts.filter(pa.array(learned)))[0].dictionary_encode()
                n = np.bincount(words.indices.to_numpy(zero_copy_only=False), minlength=len(words.dictionary))
                held += [(words.dictionary, n), (pa.array([b""], pa.binary()), np.array([learned.sum()]))]
                size += len(n)
                if size > 1_000_000:
                    words, n = merged()
                    yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], names=["word", "n"])
                    held, size = [], 0
        if held:
            words, n = merged()
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(n)], names=["word", "n"])

    return docs.mapInArrow(tidy(rows), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def known_words(counts: DataFrame, limit: int | None = None) -> list[tuple[str, int]]:
    """The end, and the most frequent words, limit at most: all above a count, which is found from how often each count occurs."""
    limit = limit or KNOWN
    least, total = None, 0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("words")).collect(), reverse=True):
        total += r["words"]
        if total > limit:
            break
        least = r["n"]
    wanted = F.col("word") == "" if least is None else (F.col("word") == "") | (F.col("n") >= least)
    found = {"": 0} | {r["word"]: r["n"] for r in counts.filter(wanted).collect()}
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


def rare_masses(counts: DataFrame, own: set[str]) -> np.ndarray:
    """For each unit of rarer words, the sum of n + 0.5 over its words, and 0.5 for unknown ones."""

    def rows(batches):
        total = np.zeros(SHAPES * gru.SIZE)
        for batch in batches:
            pairs = [(w.encode(), n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if w not in own]
            if pairs:
                words, n = zip(*pairs)
                total += np.bincount(rare_units(list(words)), np.array(n) + 0.5, len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"unit": pa.array(at, pa.int32()), "mass": pa.array(total[at])})

    out = np.full(SHAPES * gru.SIZE, 0.5)
    for r in counts.mapInArrow(tidy(rows), "unit int, mass double").groupBy("unit").agg(F.sum("mass").alias("mass")).collect():
        out[r["unit"]] += r["mass"]
    return out


def vocabulary(counts: DataFrame) -> dict:
    """What executors know of the words, as plain arrays and dictionaries: bounded by KNOWN, whatever the corpus holds.

    words: place of each known word; n: counts by place; units: by place; own: how
    many words are units of their own, rare: the first unit of the others; mass:
    the sum of n + 0.5 of each unit.
    """
    known = known_words(counts)
    tokens, types = counts.agg(F.sum("n"), F.count("*")).first()
    words = [w.encode() for w, _ in known]
    own = min(SHORT, len(known))
    rare = -(-own // gru.SIZE) * gru.SIZE
    n = np.array([n for _, n in known], np.float64)
    units = np.append(np.arange(own), rare + rare_units(words[own:]))
    mass = np.zeros(rare)
    mass[:own] = n[:own] + 0.5
    mass = np.append(mass, rare_masses(counts, {w for w, _ in known[:own]}))
    return {"words": {w: k for k, w in enumerate(words)}, "n": n, "units": units.astype(np.int64), "own": own, "rare": rare, "mass": mass, "tokens": tokens or 0, "types": types}


def start_weights(mass: np.ndarray) -> dict[str, np.ndarray]:
    """Weights that say the shares of the counts."""
    of_class = mass.reshape(-1, gru.SIZE)
    sums = of_class.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        return gru.init(len(mass) + 1, np.log(sums[:, 0] / sums.sum()), np.maximum(np.log(of_class / sums), -30))


def encode(v: dict, keys: pa.Array, texts: pa.Array, first_row: int) -> pa.RecordBatch:
    """A row for each text: row, doc_id, fold, n_tokens, n_known, base, inside, rare, units.

    base and inside are what the known words' counts add to the base score and to
    the score besides the model's part; rare are the words that aren't known.
    """
    words, counts = split_words(texts)
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    values = pa.concat_arrays([coded.dictionary, pa.array([b""], pa.binary())])
    place = pc.index_in(values, value_set=pa.array(v["words"], pa.binary())).fill_null(-1).to_numpy().astype(np.int64)
    strange = np.flatnonzero(place < 0)
    units = v["units"][place]
    units[strange] = v["rare"] + rare_units(values.take(pa.array(strange)).to_pylist())
    log_n = np.log10(v["n"] + 0.5)[place]
    log_n[strange] = 0
    inside = np.where((place >= 0) & (place < v["own"]), 0, log_n - np.log10(v["mass"][units]))
    # one end, the last of the distinct words, behind each text
    docs = np.repeat(np.arange(len(counts)), counts)
    sizes = counts + 1
    every = np.full(int(sizes.sum()), len(values) - 1, np.int64)
    every[np.arange(len(codes)) + docs] = codes
    docs = np.repeat(np.arange(len(counts)), sizes)
    sums = lambda x: np.bincount(docs, x[every], len(counts))
    total = np.log10(v["tokens"] + 0.5 * (v["types"] + 1))
    unknown = place[codes] < 0
    behind = np.append(0, np.cumsum(np.bincount(np.repeat(np.arange(len(counts)), counts), unknown, len(counts)))).astype(np.int32)
    rare = pa.ListArray.from_arrays(pa.array(behind), words.filter(pa.array(unknown)).cast(pa.string()))
    data = units[every].astype("<u2")
    ends = np.append(0, 2 * np.cumsum(sizes)).astype(np.int32)
    ids = keys.to_pylist()
    columns = [
        pa.array(np.arange(first_row, first_row + len(ids))), pa.array(ids, pa.int64()), pa.array([fold(k) for k in ids], pa.int32()), pa.array(sizes.astype(np.int64)),
        pa.array(sums(((place >= 0) & (v["n"][place] > 0)).astype(np.float64)).astype(np.int64)), pa.array(sums(log_n) - sizes * total), pa.array(sums(inside)), rare,
        pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends), pa.py_buffer(data)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "fold", "n_tokens", "n_known", "base", "inside", "rare", "units"])


def encoded(docs: DataFrame, vocab) -> DataFrame:
    """The rows of ``encode`` of all (doc_id, text)."""

    def rows(batches):
        at = TaskContext.get().partitionId() << 33
        for keys, texts in texts_of(batches):
            yield encode(vocab.value, keys, texts, at)
            at += len(keys)

    return docs.mapInArrow(tidy(rows), "row long, doc_id long, fold int, n_tokens long, n_known long, base double, inside double, rare array<string>, units binary")


def buffers(batches, column: str = "units"):
    """(rows of a batch's columns, arrays of units) for runs of about BUFFER tokens."""
    held, units, size = [], [], 0
    for batch in batches:
        data = batch.column(column)
        for k in range(batch.num_rows):
            units.append(np.frombuffer(data[k].as_py(), "<u2"))
            size += len(units[-1])
            held.append((batch, k))
            if size > BUFFER:
                yield held, units
                held, units, size = [], [], 0
    if units:
        yield held, units


def train_round(rows: DataFrame, weights: dict[str, np.ndarray], folds: tuple[int, ...]) -> dict[str, np.ndarray]:
    """One round: every task trains a copy of the weights on its documents of these folds; their average by tokens seen."""
    held = rows.sparkSession.sparkContext.broadcast(weights)
    size = 1 << 14

    def trained(batches):
        trainer = gru.Trainer(held.value)
        start = len(held.value["E"]) - 1
        for _, documents in buffers(batches):
            h = None
            for inputs, fresh, units, mask, _, count in gru.lanes_of(documents, start):
                h = np.zeros((count, gru.HIDDEN), np.float32) if h is None else h[:count]
                h = trainer.window(inputs, fresh, units, mask, h)
        if trainer.seen:
            values = gru.flat(trainer.p).astype("<f4")
            parts = [values[k : k + size].tobytes() for k in range(0, len(values), size)]
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_pydict({"part": pa.array(range(len(parts)), pa.int32()), "slot": pa.array([slot] * len(parts), pa.int32()), "seen": pa.array([trainer.seen] * len(parts), pa.int64()), "weights": pa.array(parts, pa.binary())})

    def averaged(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for part, slot, n, data in zip(*(c.to_pylist() for c in batch.columns)):
                sums[part, slot] = sums.get((part, slot), 0) + n * np.frombuffer(data, "<f4").astype(np.float64)
                seen[part, slot] = seen.get((part, slot), 0) + n
        if sums:
            keys = list(sums)
            columns = [pa.array([p for p, _ in keys], pa.int32()), pa.array([s for _, s in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64()), pa.array([(sums[k] / seen[k]).astype("<f4").tobytes() for k in keys], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "slot", "seen", "weights"])

    kinds = "part int, slot int, seen long, weights binary"
    own = rows.filter(F.col("fold").isin(list(folds))).select("units").mapInArrow(tidy(trained), kinds)
    slots = own.repartition("part", "slot").mapInArrow(tidy(averaged), kinds).withColumn("slot", F.lit(0))
    found = sorted(slots.repartition("part").mapInArrow(tidy(averaged), kinds).select("part", "weights").collect())
    if not found:
        return weights
    return gru.unflat(weights, np.frombuffer(b"".join(bytes(r["weights"]) for r in found), "<f4"))


def train(rows: DataFrame, v: dict) -> dict[str, np.ndarray]:
    weights = start_weights(v["mass"])
    for folds in ROUNDS:
        weights = train_round(rows, weights, folds)
    return weights


def model_scores(weights: dict[str, np.ndarray], documents: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each document's units, its state carried from its first to its last."""
    sums = np.zeros(len(documents))
    h, held, room = None, [], gru.Room()
    E, O = gru.behind_ones(weights["E"]), gru.with_one(weights["O"], weights["o"])

    def add():
        states, units, own = (np.concatenate(x) if len(x) > 1 else x[0] for x in zip(*held))
        held.clear()
        return np.bincount(own, gru.log_probabilities(weights, states, units, room, O), len(sums))

    for inputs, fresh, units, mask, number, count in gru.lanes_of(documents, len(weights["E"]) - 1):
        h = np.zeros((count, gru.HIDDEN), np.float32) if h is None else h[:count]
        states, _ = gru.forward(weights, E, inputs, fresh, h, room)
        h = states[-1, 1:].T.copy()
        real = np.flatnonzero(mask.ravel())
        rows = gru.by_step(states[1:], room).reshape(-1, 1 + gru.HIDDEN)
        full = len(real) == len(rows) > 6_000
        held.append((rows if full else rows.take(real, axis=0, mode="clip"), units.ravel()[real], number.ravel()[real]))
        if full or sum(len(x[1]) for x in held) > 6_000:
            sums += add()
    if held:
        sums += add()
    return sums


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each (doc_id, text).

    A null text is an empty one: its one token is the end.  Repeated rows are
    documents of their own.  Without training documents every word is unknown.
    An empty table gives no rows.  Texts may be of any length; a very long one is
    read by one lane from start to end.  Other columns are not looked at.
    """
    docs = docs.select("doc_id", whole_text().alias("text"))
    sc = docs.sparkSession.sparkContext
    counts = saved(count_words(docs))
    v = vocabulary(counts)
    rows = saved(encoded(docs, sc.broadcast(v)))
    weights = sc.broadcast(train(rows, v))
    names = ("row", "doc_id", "fold", "n_tokens", "n_known", "base")

    def scored(batches):
        for held, documents in buffers(batches):
            logs = model_scores(weights.value, documents) / np.log(10)
            some: list[pa.RecordBatch] = []
            ks: list[list[int]] = []
            for batch, k in held:
                if not some or some[-1] is not batch:
                    some.append(batch)
                    ks.append([])
                ks[-1].append(k)
            out = pa.Table.from_batches([b.take(pa.array(k)) for b, k in zip(some, ks)]).combine_chunks()
            inside = out.column("inside").to_numpy()
            yield pa.RecordBatch.from_arrays([*(out.column(n).combine_chunks() for n in names), pa.array(inside + logs)], names=[*names, "score"])

    found = rows.select(*names, "inside", "units").mapInArrow(tidy(scored), "row long, doc_id long, fold int, n_tokens long, n_known long, base double, score double")
    # words beyond the known ones: their counts come by a join; each adds log10(n + 0.5) to both scores
    rare = rows.select("row", F.explode("rare").alias("word"))
    n = F.coalesce("n", F.lit(0))
    more = rare.join(counts, "word", "left").groupBy("row").agg(F.sum(F.log10(n + 0.5)).alias("more"), F.count_if(n > 0).alias("known"))
    more_log = F.coalesce("more", F.lit(0.0))
    return found.join(more, "row", "left").select(
        "doc_id", (F.col("fold") == HELD).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v["tokens"]).cast("long").alias("train_tokens"), (F.col("base") + more_log).alias("base_score"), (F.col("score") + more_log).alias("score"),
    )
