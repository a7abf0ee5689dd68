"""Benchmark decontamination by spaced-seed hashing (operator 5), DataFrame functions only.

A seed looks at five words of a window and ignores the others, as a fixed mask
says, so a substituted word spoils only the seeds that look at it.  The seeds of
all test items are joined to those at every position of every training text; a
hit fixes an alignment, and there all words of the item are compared with the
text.  What leaked is the longest run of the item's words, of OVERLAP words at
least or the whole item, of which at least 0.8 agree.  The masks alone could miss
that in items of up to 7 and of 10 words, which get seeds of runs of words, one of which
no allowed substitution spoils; items of up to 4 words are seeds as a whole.  All letters are lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, unused, whole_text

#: Word positions that a seed looks at.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 3, 4, 6), (0, 2, 3, 5, 7), (0, 1, 4, 6, 8))
#: Words of a run that serves as a seed too, by the words of an item that the masks can miss; items of 1 to 4 words must agree as a whole.
RUNS = {1: 1, 2: 2, 3: 3, 4: 4, 5: 2, 6: 3, 7: 3, 10: 3}
SIMILARITY = 0.8
#: Words of a partial overlap, at least: from 11 on, no run that agrees to 0.8 can escape all masks.
OVERLAP = 11
#: Seeds of test items up to which they are broadcast (about 40 bytes each); beyond, both sides are shuffled.
BROADCAST_SEEDS = 1_000_000


def word_hashes(text: Column, fold=F.lower) -> Column:
    """The hashes of a folded text's words."""
    words = F.filter(F.split(fold(text), WORD_GAP), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(hashes: DataFrame, columns: list[str], runs: dict[int, Column] | None = None) -> DataFrame:
    """columns, at and seed, for each position and each mask that fits into the hashes w; runs: where seeds of so many words are taken."""
    placed = hashes.select(*dict.fromkeys([*columns, "w"]), F.posexplode("w").alias("at", "_"))
    masks = [(k, mask, F.lit(True)) for k, mask in enumerate(MASKS)] + [(-n, tuple(range(n)), where) for n, where in (runs or {}).items()]
    of_mask = [
        F.when(where & (F.col("at") + (mask[-1] + 1) <= F.size("w")), F.xxhash64(F.lit(k), *[F.get("w", F.col("at") + p) for p in mask]))
        for k, mask, where in masks
    ]
    return placed.select(*columns, "at", F.explode(F.array(*of_mask)).alias("seed")).filter("seed is not null")


def compared(docs: DataFrame, items: DataFrame, fold=F.lower) -> DataFrame:
    """(doc_id, item_id, at, same) of each alignment that a seed hits: same has 1 for each word of the item that agrees, else 0."""
    tests = items.select("item_id", word_hashes(whole_text(), fold).alias("w")).distinct()
    tests = tests.filter(F.size("w") > 0)
    sizes = [r[0] for r in tests.select(F.size("w")).filter(F.size("w").isin(list(RUNS))).distinct().collect()]
    of_items = {n: F.size("w").isin([k for k in sizes if RUNS[k] == n]) & (F.col("at") % n == 0) for n in {RUNS[k] for k in sizes}}
    of_texts = {n: F.lit(True) for n in of_items}
    test_seeds = seeds(tests, ["item_id"], of_items).select("seed", "item_id", F.col("at").alias("item_at")).distinct()
    texts = docs.select("doc_id", F.xxhash64(whole_text()).alias("th"), word_hashes(whole_text(), fold).alias("w"))
    items_w = tests.select("item_id", F.col("w").alias("item_w"))
    shift = (F.col("at") - F.col("item_at")).alias("at")
    if test_seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        # nothing is shuffled, so the words stay beside the seeds
        hits = seeds(texts, ["doc_id", "w"], of_texts).join(F.broadcast(test_seeds), "seed").select("doc_id", "item_id", "w", shift)
        items_w = F.broadcast(items_w)
    else:
        # the join shuffles seeds only; the words come back to the few places that are hit
        places = seeds(texts, ["doc_id", "th"], of_texts).join(test_seeds, "seed").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "item_id", shift).distinct()
        hits = texts.join(places, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t"))).select("doc_id", "item_id", "w", "at")
    same = F.transform("item_w", lambda x, k: F.when(F.get("w", k + F.col("at")) == x, 1).otherwise(0))
    return hits.join(items_w, "item_id").select("doc_id", "item_id", "at", same.alias("same"))


def agreed(same: Column) -> Column:
    return F.aggregate(same, F.lit(0), lambda a, b: a + b)


def leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, fold=F.lower) -> DataFrame:
    """(doc_id, item_id, at, item_words, matched): each place of a text where an item leaked.

    docs: (doc_id, text); items: (item_id, text).  at: the text's word under the
    item's first, negative if the text starts inside the item.  Words outside the
    text don't agree.  Null and empty texts have
    no leaks.  Repeated rows give one row.  fold: what makes cases of letters one.
    """
    matched = agreed(F.col("same"))
    return (
        compared(docs, items, fold)
        .select("doc_id", "item_id", "at", F.size("same").alias("item_words"), matched.alias("matched"))
        .filter(F.col("matched") >= similarity * F.col("item_words"))
        .distinct()
    )


def overlaps(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, least: int = OVERLAP, fold=F.lower) -> DataFrame:
    """(doc_id, item_id, at, item_words, start, words, matched): the longest run of each alignment that agrees.

    docs: (doc_id, text); items: (item_id, text).  A run is of at least ``least``
    words of the item, from its word start on, or the whole item, and at least
    similarity of the run's words agree.  Of equally long runs the first is given.
    at: the text's word under the item's first, negative if the text starts inside
    the item; words outside the text don't agree.  Words that a text adds or leaves
    out part an item into runs of two alignments.  Null and empty
    texts, and items without words, overlap with nothing; repeated rows give one row; texts may
    be of any length; other columns are not looked at.
    """
    size, agree = F.size("same"), agreed(F.col("same"))
    found = compared(docs, items, fold).filter(agree >= similarity * F.least(size, F.lit(least)))
    # counts of agreeing words before each place; after distinct they aren't computed anew for each pair of places
    counts = F.aggregate("same", F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    found = found.select("doc_id", "item_id", "at", size.alias("item_words"), counts.alias("before")).distinct()

    each = found.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("item_words") - F.least("item_words", F.lit(least)))))
    ends = F.filter(F.sequence(F.col("i") + F.least("item_words", F.lit(least)), F.col("item_words")), lambda j: F.get("before", j) - F.get("before", F.col("i")) >= similarity * (j - F.col("i")))
    each = each.withColumn("end", F.array_max(ends)).filter("end is not null")
    run = F.struct((F.col("end") - F.col("i")).alias("words"), (-F.col("i")).alias("minus"), (F.get("before", F.col("end")) - F.get("before", F.col("i"))).alias("matched"))
    longest = each.groupBy("doc_id", "item_id", "at", "item_words", "before").agg(F.max(run).alias("run"))
    return longest.select("doc_id", "item_id", "at", "item_words", (-F.col("run.minus")).alias("start"), "run.words", "run.matched")


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are and of any name, that overlap with no item, whole or in part, in whichever case of letters.

    Null and empty texts stay; rows of one doc_id, repeated ones among them, stay or go together.
    """
    name = unused(docs, "sluice_leaked")
    bad = overlaps(docs, items).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


OVERLAPS_SQL = r"""
with d as (select distinct doc_id, regexp_split_to_array(trim(lower(coalesce(text, '')), E' \t\n\x0B\f\r'), '[\x20\x09-\x0D]+') w from documents),
b as (select distinct item_id, regexp_split_to_array(trim(lower(coalesce(text, '')), E' \t\n\x0B\f\r'), '[\x20\x09-\x0D]+') w from benchmark),
dn as (select row_number() over () t, * from d), bn as (select row_number() over () u, * from b where w <> ['']),
dw as (select t, doc_id, unnest(w) x, generate_subscripts(w, 1) p from dn),
bw as (select u, item_id, len(w) n, unnest(w) x, generate_subscripts(w, 1) p from bn),
m as (select t, u, doc_id, item_id, dw.p - bw.p a, n, list(bw.p) ps from dw join bw using (x) group by t, u, doc_id, item_id, dw.p - bw.p, n having count(*) >= 0.8 * least(n, 11)),
s as (select *, unnest(range(0, n - least(n, 11) + 1)) i from m),
r as (select *, unnest(range(i + least(n, 11), n + 1)) j from s),
k as (select *, len(list_filter(ps, lambda p: p > i and p <= j)) c from r)
select distinct doc_id, item_id, "at", item_words, "start", words, matched from (
  select doc_id, item_id, cast(a as int) "at", cast(n as int) item_words, cast(i as int) "start", cast(j - i as int) words, cast(c as int) matched,
    row_number() over (partition by t, u, a order by j - i desc, i) best
  from k where c >= 0.8 * (j - i)) where best = 1
"""
