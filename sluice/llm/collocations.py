"""Phrase collocations, counted with position bitmaps in the manner of SPAM (operator 12).

A shard is a run of texts in one task.  Its words stand at numbered positions, with
an empty position between pieces and between texts.  Each word has the bitmap of its
positions, compressed to the bytes that aren't zero.  A phrase's bitmap, shifted by
one position, ANDed with a word's bitmap is that of the longer phrase, and its
popcount is the phrase's count in the shard; since a shift over a piece's end meets
the empty position, no phrase passes it.  Phrases are extended depth-first, a slice of
first words at a time, and popcounts are summed over shards.

There is one walk for each length.  A phrase is only extended if it, and the words
that would end the longer one, occur often enough in all shards; shards know that
from bit tables of a fixed size, set at the hashes of frequent phrases.  A bit that is
set by chance costs work and changes no result, since sums are exact.

Words go by a 64-bit hash of language and word; should two words share one, all are
hashed anew.  A phrase's key is the hashes of its words, 8 bytes each.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, tidy, whole_text
from .words import bytes_of, chunks, packed

LONGEST, LEAST, TOP = 3, 10, 2000
#: A phrase goes if a longer candidate that holds it has this share of its occurrences, in hundredths.
INSIDE = 50
SCALE = 1_000_000
#: Bytes of texts in a shard, and bitmap bytes that are extended at once.
SHARD, SLICE = 6 << 20, 1 << 17
#: Bits of a bit table, as a power of two: 8 MB.
TABLE_BITS = 26
#: Parts in which a language's phrases are ranked first.
PARTS = 32

#: Bytes as they are, A-Z lower-cased, marks and line ends that part pieces as 10, blanks and tabs as 32.
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[65:91] += 32
FOLDED[[*b".,;:!?", 10, 11, 12, 13]] = 10
FOLDED[9] = 32


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(the words of all texts, words of each text, the position of each word)."""
    raw, at = bytes_of(texts)
    raw = FOLDED[raw]
    mark = raw == 10
    solid = ~mark & (raw != 32)
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    first = at[:-1][at[:-1] < len(raw)]
    begin[first] = solid[first]
    starts = np.flatnonzero(begin)
    counts = np.diff(np.searchsorted(starts, at))
    piece = np.cumsum(mark, dtype=np.int32)[starts] + np.repeat(np.arange(len(counts), dtype=np.int32), counts)
    place = np.cumsum(solid, dtype=np.int32)
    gaps = np.cumsum(np.diff(piece, prepend=piece[:1]) != 0, dtype=np.int32)
    return packed(raw[solid], place[starts] - 1), counts, np.arange(len(starts), dtype=np.int32) + gaps


def mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of several unsigned columns, row by row."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def buckets(columns: list[np.ndarray]) -> np.ndarray:
    return (mixed(columns) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def is_set(table: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return (table[bucket >> 6] >> (bucket & 63).astype(np.uint64)) & np.uint64(1) == 1


def key_columns(keys: pa.Array, length: int) -> list[np.ndarray]:
    """The word hashes of keys of so many words."""
    raw, _ = bytes_of(keys)
    return list(np.ascontiguousarray(raw).view("<u8").reshape(-1, length).T)


def keys_of(columns: list[np.ndarray]) -> pa.Array:
    n, length = len(columns[0]), len(columns)
    raw = np.ascontiguousarray(np.stack(columns, 1).astype("<u8")).view(np.uint8).ravel()
    return packed(raw, np.arange(n) * (8 * length))


def bit_table(keys: DataFrame, length: int) -> np.ndarray:
    """Bits set at the hashes of keys of so many words; at most 2^TABLE_BITS of them reach the driver, 64 in a row."""

    def rows(batches):
        for batch in batches:
            bucket = np.sort(buckets(key_columns(batch.column(0), length)))
            slot, at = np.unique(bucket >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (bucket & 63).astype(np.uint64), at) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slot, pa.int64()), "bits": pa.array(bits.view(np.int64))})

    found = keys.select("key").mapInArrow(tidy(rows), "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (TABLE_BITS - 6), np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


class Shard:
    """The bitmaps of a shard's words: of each byte that isn't zero its word, block (position / 8) and bits."""

    def __init__(self, texts: pa.Array, langs: list[str], seed: int, known: np.ndarray | None = None):
        import xxhash

        words, counts, place = words_of(texts)
        codes, names = pa.array(langs, pa.string()).dictionary_encode(), None
        names = codes.dictionary.to_pylist()
        coded = words.dictionary_encode()
        both = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(names) + np.repeat(codes.indices.to_numpy(zero_copy_only=False), counts)
        ids = pa.array(both).dictionary_encode()
        pairs, ids = ids.dictionary.to_numpy(), ids.indices.to_numpy(zero_copy_only=False)
        self.words, self.langs = coded.dictionary.take(pa.array(pairs // len(names))), [names[k] for k in (pairs % len(names)).tolist()]
        heads = [f"{len(x)}:{x}:".encode() for x in names]
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(heads[k] + w, seed) for k, w in zip((pairs % len(names)).tolist(), self.words.to_pylist())), np.uint64, len(pairs))
        if known is not None:
            kept = is_set(known, buckets([self.hashes]))[ids]
            ids, place = ids[kept], place[kept]
        order = np.argsort(ids, kind="stable")
        word, place = ids[order], place[order]
        del ids, order, both, coded, codes, words
        block = place >> 3
        new = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        self.word, self.block = word[new], block[new]
        self.bits = np.bitwise_or.reduceat((1 << (place & 7)).astype(np.uint8), new) if len(new) else np.zeros(0, np.uint8)
        self.by_block = np.argsort(self.block, kind="stable").astype(np.int32)
        self.blocks = int(self.block.max()) + 2 if len(new) else 0
        self.block_start = np.searchsorted(self.block[self.by_block], np.arange(self.blocks + 1))

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.word, np.bitwise_count(self.bits), len(self.hashes)).astype(np.int64)

    def extended(self, phrase: np.ndarray, block: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, ...]:
        """(phrase, next word, block, bits): the bitmaps shifted by one, ANDed with those of all words that have bits in the same block."""
        low, carry = bits << 1, bits >> 7
        a, b = np.flatnonzero(low), np.flatnonzero(carry)
        phrase, block, bits = np.concatenate([phrase[a], phrase[b]]), np.concatenate([block[a], block[b] + 1]), np.concatenate([low[a], carry[b]])
        inside = block < self.blocks
        phrase, block, bits = phrase[inside], block[inside], bits[inside]
        n = self.block_start[block + 1] - self.block_start[block]
        of = np.repeat(np.arange(len(block)), n)
        other = self.by_block[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.block_start[block], n)]
        both = bits[of] & self.bits[other]
        hit = np.flatnonzero(both)
        of, other = of[hit], other[hit]
        return phrase[of], self.word[other], block[of], both[hit]

    def walk(self, depth: int, tables: list[np.ndarray]):
        """(word hashes by place, counts) of phrases of depth words; tables[d]: bits of frequent phrases of d words."""
        for k in range(0, len(self.word), SLICE):
            part = slice(k, k + SLICE)
            yield from self.down(depth, tables, [np.arange(len(self.hashes))], self.word[part], self.block[part], self.bits[part])

    def down(self, depth: int, tables: list[np.ndarray], chain: list[np.ndarray], phrase, block, bits):
        """``walk`` from phrases on whose words, place by place, are in chain; a method, as an inner function that calls itself would keep the shard until the collector runs."""
        here, (phrase, word, block, bits) = len(chain) + 1, self.extended(phrase, block, bits)
        if not len(phrase):
            return
        order = np.argsort(phrase.astype(np.int64) * len(self.hashes) + word, kind="stable")
        phrase, word, block, bits = phrase[order], word[order], block[order], bits[order]
        starts = np.flatnonzero((np.diff(phrase, prepend=-1) != 0) | (np.diff(word, prepend=-1) != 0))
        longer = [c[phrase[starts]] for c in chain] + [word[starts]]
        hashes = [self.hashes[c] for c in longer]
        keep = np.ones(len(starts), bool)
        if here > 2:
            keep = is_set(tables[here - 1], buckets(hashes[1:]))
        if here < depth:
            keep &= is_set(tables[here], buckets(hashes))
        if here == depth:
            counts = np.add.reduceat(np.bitwise_count(bits), starts, dtype=np.int64)
            yield [h[keep] for h in hashes], counts[keep]
        else:
            sizes = np.diff(starts, append=len(phrase))
            rank = np.cumsum(keep) - 1
            stay = np.repeat(keep, sizes)
            yield from self.down(depth, tables, [c[keep] for c in longer], np.repeat(rank, sizes)[stay], block[stay], bits[stay])


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(whole_text().alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))


def shards(batches):
    for batch in batches:
        texts, langs = batch.column(0), batch.column(1).to_pylist()
        for a, b in chunks(texts, SHARD):
            yield texts.slice(a, b - a), langs[a:b]


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(key, lang, word, n) of every word of (text, lang)."""

    def rows(batches):
        for texts, langs in shards(batches):
            s = Shard(texts, langs, seed)
            if len(s.hashes):
                yield pa.RecordBatch.from_pydict({"key": keys_of([s.hashes]), "lang": pa.array(s.langs, pa.string()), "word": s.words.cast(pa.string()), "n": pa.array(s.word_counts())})
            del s  # before the next one is made

    counts = texts_of(docs).mapInArrow(tidy(rows), "key binary, lang string, word string, n long")
    return counts.groupBy("key", "lang", "word").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, seed: int, depth: int, tables: list) -> DataFrame:
    """(key, n) of the phrases of depth words all of whose parts may be frequent."""

    def rows(batches):
        known = [None if t is None else t.value for t in tables]
        for texts, langs in shards(batches):
            for hashes, counts in Shard(texts, langs, seed, known[1]).walk(depth, known):
                yield pa.RecordBatch.from_pydict({"key": keys_of(hashes), "n": pa.array(counts)})

    return texts_of(docs).mapInArrow(tidy(rows), "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def counted(docs: DataFrame, longest: int, least: int, seed: int = 0) -> list[DataFrame]:
    """[all words (key, lang, word, n), frequent phrases (key, n) of one word, of two, ...]."""
    spark = docs.sparkSession
    while True:
        words = saved(word_counts(docs, seed))
        if not words.groupBy("key").count().filter("count > 1").limit(1).count():
            break
        seed += 1
    levels, tables = [words, words.filter(F.col("n") >= least).select("key", "n")], [None]
    for depth in range(2, longest + 1):
        tables.append(spark.sparkContext.broadcast(bit_table(levels[-1], depth - 1)))
        levels.append(saved(phrase_counts(docs, seed, depth, tables).filter(F.col("n") >= least)))
    return levels


def part(key: Column | str, at: int, n: int) -> Column:
    """The key of n words of a key, from word number at on."""
    return F.substring(key, 8 * at + 1, 8 * n)


def wide(c: str) -> Column:
    """A count whose products with others are exact."""
    return F.col(c).cast("decimal(15,0)")


def scored(levels: list[DataFrame], length: int) -> DataFrame:
    """(key, a, l, r, score, lang, phrase) of candidates of so many words, by the cut of the lowest score, the earliest of equal ones."""
    out = levels[length].withColumnRenamed("n", "a")
    cuts = []
    for k in range(1, length):
        for side, at, n in (("l", 0, k), ("r", k, length - k)):
            count = levels[n].select(F.col("key").alias("part"), F.col("n").alias(f"{side}{k}"))
            out = out.join(count, part("key", at, n) == F.col("part")).drop("part")
        score = F.call_function("div", wide("a") * wide("a") * F.lit(SCALE).cast("decimal(7,0)"), wide(f"l{k}") * wide(f"r{k}"))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    out = out.select("key", "a", F.array_min(F.array(*cuts)).alias("cut")).select("key", "a", "cut.l", "cut.r", "cut.score")
    for k in range(length):
        word = levels[0].select(F.col("key").alias("part"), F.col("word").alias(f"w{k}"), *(["lang"] if not k else []))
        out = out.join(word, part("key", k, 1) == F.col("part")).drop("part")
    return out.select("key", "a", "l", "r", "score", "lang", F.concat_ws(" ", *[f"w{k}" for k in range(length)]).alias("phrase"))


def not_inside(levels: list[DataFrame], length: int, found: DataFrame) -> DataFrame:
    """Without the phrases of so many words that a longer candidate holds often enough."""
    longer = [levels[m].select(F.explode(F.array(*[part("key", k, length) for k in range(m - length + 1)])).alias("held"), "n") for m in range(length + 1, len(levels))]
    if not longer:
        return found
    most = reduce(DataFrame.unionByName, longer).groupBy("held").agg(F.max("n").alias("most"))
    joined = found.join(most, F.col("key") == F.col("held"), "left")
    return joined.filter(F.col("most").isNull() | (100 * F.col("most") < INSIDE * F.col("a"))).drop("held", "most")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of two to longest words of each language of (text, lang).

    A null text counts as empty, a null lang as "und"; an empty lang is one of its own.
    Texts may be of any length, repeated rows count as often as they come, equal
    scores go by count and then by phrase, an empty table gives no rows, and other
    columns are not looked at.  Counts of up to 15 digits are exact.
    """
    levels = counted(docs, longest, least)
    found = reduce(DataFrame.unionByName, [not_inside(levels, m, scored(levels, m)) for m in range(2, longest + 1)])
    best = [F.desc("score"), F.desc("a"), "phrase"]
    for parts in (["lang", F.pmod(F.xxhash64("key"), F.lit(PARTS))], ["lang"]):  # a language's rows are cut to top in parts before they meet
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*parts).orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    totals = levels[0].groupBy("lang").agg(F.sum("n").alias("n"))
    return found.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL for what the query returns.
SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM t),
g AS (SELECT lang, m, unnest([ws[i : i + m - 1] for i in range(1, len(ws) - m + 2)]) AS ws FROM w, (SELECT unnest([1, 2, 3]) AS m)),
f AS (SELECT lang, m, ws, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
c AS (SELECT * FROM f WHERE m > 1 AND a >= {LEAST}),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c),
s AS (SELECT k.lang, k.m, k.ws, k.a, k.k, x.a AS l, y.a AS r, ({SCALE} * k.a * k.a) // (x.a * y.a) AS score FROM k
  JOIN f x ON x.lang = k.lang AND x.ws = k.ws[1 : k.k] JOIN f y ON y.lang = k.lang AND y.ws = k.ws[k.k + 1 :]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
o AS (SELECT lang, ws, max(a) AS most FROM (SELECT lang, a, unnest([ws[1:2], ws[2:3]]) AS ws FROM c WHERE m = 3) GROUP BY ALL),
d AS (SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, b.a, b.l, b.r, b.score FROM b LEFT JOIN o ON o.lang = b.lang AND o.ws = b.ws WHERE most IS NULL OR 100 * most < {INSIDE} * b.a),
n AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang)
SELECT d.lang, row_number() OVER (PARTITION BY d.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n.n::BIGINT AS n, score::BIGINT AS score
FROM d JOIN n ON n.lang = d.lang QUALIFY rank <= {TOP}
"""
