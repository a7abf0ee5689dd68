"""Fill-in-middle, collocations and the Jaccard join against brute force."""

import gc
import hashlib
import random
import re
import weakref
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("sluice.llm")

from sluice.llm import collocations, fill_middle, jaccard  # noqa: E402

#: Columns whose names operators use inside.
CLASHES = ("key", "n", "a", "l", "r", "s", "t", "u", "v", "x", "sig", "root", "low", "form", "output", "word", "phrase", "rank", "part", "c0", "nu")
SPACE = "[\\x20\\x09-\\x0D]"


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.withColumns({c: F.lit(c) for c in CLASHES}).repartition(3)


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


# fill in middle


def fim(doc_id, text):
    units = re.findall(f"{SPACE}*[^\\x20\\x09-\\x0D]+|{SPACE}+", text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aé \n\x0b<>PSM\x1c\U0001f600", max_size=60), st.integers(-5, 400), st.integers(1, 9))
def test_rearranged_and_restored(text, doc_id, size):
    made = fill_middle.rearranged(doc_id, text, size=size)
    assert made == fim(doc_id, text)
    assert fill_middle.restored(made[2], made[1], size) == text


def test_rope_is_balanced_and_splits_anywhere():
    r = random.Random(3)
    text = "".join(r.choice(("a", "bé ", " \n", "long-word ", "\U0001f600 x")) for _ in range(3000))
    units = re.findall(f"{SPACE}*[^\\x20\\x09-\\x0D]+|{SPACE}+", text)
    rope = fill_middle.build(text, 8)
    assert (rope.units, rope.chars) == (len(units), len(text))
    for k in (0, 1, 7, len(units) // 3, len(units) - 1, len(units)):
        a, b = fill_middle.split(rope, k)
        assert fill_middle.text_of(a) == "".join(units[:k]) and fill_middle.text_of(b) == "".join(units[k:])
        assert fill_middle.chars(a) == len("".join(units[:k]))
        joined = fill_middle.concat(b, a)
        assert joined.height <= 2 * np.log2(len(text)) and joined.units == len(units)
    for k in (1, 500, len(text) - 1):
        a, b = fill_middle.split(rope, k, "chars")
        assert fill_middle.text_of(a) == text[:k] and fill_middle.text_of(b) == text[k:]


def test_fill_in_middle_rows(spark):
    r = random.Random(2)
    texts = [None, "", "  ", "word", " a", "a ", "x" * 300_000, "y z " * 40_000, "has <S> inside", "<", "<P", *(" ".join(r.choice(("ab", "c<", "S>", "é")) for _ in range(r.randint(1, 60))) for _ in range(40))]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(3, "word", "en"), (3, "another", None), (None, "no id at all", "en")]
    made = fill_middle.restore(fill_middle.fill_in_middle(table(spark, rows))).collect()
    got = sorted(((x.doc_id, x.n, x.form, x.output, x.prefix_chars, x.middle_chars) for x in made), key=str)
    assert got == sorted(((d, *fim(d, t or "")) for d, t, _ in rows), key=str)
    assert Counter((x.doc_id, x.text) for x in made) == Counter((d, t or "") for d, t, _ in rows)
    assert {x.form for x in made} == {"plain", "spm", "psm"}
    assert fill_middle.restore(fill_middle.fill_in_middle(table(spark, rows).limit(0))).count() == 0


# collocations


def phrases(rows, longest=3, least=10, top=2000):
    f, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", lower(text or "")):
            words = [w for w in re.split("[ \\t]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, longest + 1):
                for k in range(len(words) - n + 1):
                    f[lang][tuple(words[k : k + n])] += 1
    out = []
    for lang, counts in f.items():
        good = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[k : k + len(p)] == p for k in range(len(q) - len(p) + 1)) for q, b in good.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        found.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, k + 1, p, a, x, y, total[lang], s) for k, (s, a, p, x, y) in enumerate(found[:top])]
    return sorted(out)


def spoken(r, n):
    words = ["the", "The", "of", "new", "york", "city", "née", "a\x1cb", "10%", "is"]
    return "".join(r.choice(words) + r.choice((" ", " ", " ", " ", "\t", "  ", ". ", ", ", "\n", "\r\n", "!")) for _ in range(n))


def test_collocations(spark, monkeypatch):
    r = random.Random(8)
    rows = [(k, spoken(r, r.randint(0, 200)), r.choice(("en", "de", None, "und", ""))) for k in range(60)]
    rows += [(100, None, "en"), (101, "", "fr"), (102, " .,\n", "fr"), (103, "new york city " * 900, "en"), (104, "w" * 50_000, "en"), (105, "rare words", "xx"), rows[0], rows[0], (None, "of the of the", "de")]
    rows += [(200 + k, "a b c d. a b c", "tie") for k in range(12)]
    expected = phrases(rows)
    docs = table(spark, rows)
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(x) for x in collocations.collocations(docs).select(*columns).collect()) == expected
    # shards of few texts, slices that part a word's bitmap, and tables in which most bits are set by chance
    for name, value in (("SHARD", 500), ("SLICE", 61), ("TABLE_BITS", 7), ("PARTS", 2)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(tuple(x) for x in collocations.collocations(docs, 4, 5, 7).select(*columns).collect()) == phrases(rows, 4, 5, 7)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_hashes_that_meet_are_made_anew(spark, monkeypatch):
    import xxhash

    real = xxhash.xxh64_intdigest
    docs = table(spark, [(k, "one two three one two", "en") for k in range(12)])
    good = sorted(map(tuple, collocations.collocations(docs).collect()))

    class Meeting(collocations.Shard):
        def __init__(self, texts, langs, seed, known=None):
            super().__init__(texts, langs, seed, known)
            if seed == 0:
                self.hashes[:] = 7

    assert real(b"a", 0) != real(b"a", 1)
    monkeypatch.setattr(collocations, "Shard", Meeting)
    words = collocations.word_counts(docs, 0)
    assert words.groupBy("key").count().filter("count > 1").count() == 1
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == good


def test_a_walked_shard_is_given_back_at_once():
    texts = pa.array(["a b c a b c", "b c a"])
    gc.collect()
    gc.disable()
    try:
        for depth in (2, 3):
            shard = collocations.Shard(texts, ["en", "en"], 0)
            full = [np.full(1 << (collocations.TABLE_BITS - 6), ~np.uint64(0))] * 4 if depth > 2 else [None] * 4
            assert sum(n.sum() for _, n in shard.walk(depth, full)) == (7 if depth == 2 else 5)
            last = weakref.ref(shard)
            del shard
            assert last() is None
    finally:
        gc.enable()


def test_products_beyond_64_bits(spark):
    big = 3_000_000_000_000
    keys = [bytes([k]) * 8 for k in (1, 2)]
    words = spark.createDataFrame([(keys[0], "en", "x", big + 1), (keys[1], "en", "y", big)], "key binary, lang string, word string, n long")
    pairs = spark.createDataFrame([(keys[0] + keys[1], big - 7)], "key binary, n long")
    row = collocations.scored([words, words.select("key", "n"), pairs], 2).first()
    assert row.score == 1_000_000 * (big - 7) ** 2 // ((big + 1) * big) and row.phrase == "x y"


# Jaccard join


def shingles(text):
    words = [w for w in re.split(f"{SPACE}+", lower(text or "")) if w]
    return {tuple(words[k : k + 4]) for k in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} if words else set()


def joined(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(rows)), 2):
        same = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * same >= 85 * len(sets[a] | sets[b]):
            root[find(b)] = find(a)
    low = {}
    for k, (d, _, _) in enumerate(rows):
        low.setdefault(find(k), []).append(d)
    return sorted(((d, len(sets[k]), min((x for x in low[find(k)] if x is not None), default=None)) for k, (d, _, _) in enumerate(rows)), key=str)


def similar_texts(r, n):
    """Families of texts a few words apart, chains among them, and strangers with a passage in common."""
    vocabulary = [f"w{k}" for k in range(300)]
    shared = " ".join(r.choice(vocabulary) for _ in range(60))
    out = []
    for _ in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice((3, 5, 8, 9, 20, 60, 200)))]
        for _ in range(r.randint(1, 6)):
            out.append(" ".join(words))
            words = list(words)
            for _ in range(r.randint(0, max(1, len(words) // 50))):
                k = r.randrange(len(words))
                words[k : k + r.randint(0, 1)] = [r.choice(vocabulary)]
        out.append(shared + " " + " ".join(r.choice(vocabulary) for _ in range(r.choice((2, 8, 12, 30)))))
    return out


@pytest.mark.parametrize("scheme", range(len(jaccard.SCHEMES)))
def test_similar_sets_share_a_signature(scheme):
    r = np.random.default_rng(scheme)
    for n in (1, 2, 5, 6, 7, 8, 12, 13, 14, 40, 60, 100, 300, 1000, 5000):
        for _ in range(12):
            a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            least = -(-85 * len(a) // 100)
            b = a.copy() if r.random() < 0.5 else a[np.sort(r.permutation(len(a))[: r.integers(least, len(a) + 1)])]
            # replace or add as many as stay within the limit
            for _ in range(min(n, 20)):
                c = np.unique(np.append(b[r.random(len(b)) > 1 / (1 + n)], r.integers(0, 1 << 63, 1).astype(np.uint64)))
                if 100 * len(np.intersect1d(a, c)) < 85 * len(np.union1d(a, c)):
                    break
                b = c
            assert 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
            assert len(np.intersect1d(jaccard.signatures(a, scheme), jaccard.signatures(b, scheme)))


def test_bands_hold_neighbours():
    for n in range(1, 3000):
        j, last, following = jaccard.band(n)
        assert last >= n and jaccard.band(last)[0] == j and jaccard.band(last + 1)[0] == j + 1 and jaccard.band(following)[0] == j + 1
        for m in range(n, 100 * n // 85 + 1):
            assert jaccard.band(m)[0] - j in (0, 1)


def test_histograms_never_exceed_the_difference():
    r = np.random.default_rng(5)
    for _ in range(300):
        a, b = (np.unique(r.integers(0, 1 << 63, r.integers(1, 900)).astype(np.uint64) << np.uint64(r.integers(0, 2))) for _ in range(2))
        if r.random() < 0.5:
            b = np.unique(np.append(a[r.random(len(a)) < 0.9], b[:20]))
        if r.random() < 0.3:  # crowded cells
            a, b = a >> np.uint64(9), b >> np.uint64(9)
        found = jaccard.cells_apart(jaccard.histogram(a), jaccard.histogram(b))
        assert found <= len(np.setxor1d(a, b)) and found == jaccard.cells_apart(jaccard.histogram(b), jaccard.histogram(a))


def test_sketches_rule_out_sets_that_share_two_thirds():
    r = np.random.default_rng(6)
    for n in (100, 147, 400, 629, 2000):
        for _ in range(20):
            x = np.unique(r.integers(0, 1 << 63, n + n // 5).astype(np.uint64) * np.uint64(2))
            a, b = x[:n], x[len(x) - n :]
            assert 0.6 < len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.7
            assert 185 * jaccard.cells_apart(jaccard.histogram(a), jaccard.histogram(b)) > 15 * 2 * n


def test_lists_in_tiles_and_runs(spark, monkeypatch):
    texts = similar_texts(random.Random(22), 6)
    copies = [" ".join(f"w{x}" for x in range(120) if x != 7 * k) for k in range(1, 15)]
    rows = [(k, t, "en") for k, t in enumerate(texts + copies)]
    for name, value in (("TILE", 3), ("PIVOTS", 2), ("DIRECT", 1), ("PAIRS", 8), ("BLOCK", 100), ("BUCKETS", 2)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard.links, "__defaults__", (jaccard.PERCENT, 8))
    found = jaccard.similar_documents(table(spark, rows))
    assert sorted(map(tuple, found.collect()), key=str) == joined(rows)


def test_shingle_sets():
    texts = ["A b  c d\te", "a B c d e", "a b c", "a b c a b c a b c", "", " \n", "a b c d a b c d a b c d"]
    sets = jaccard.shingle_sets(pa.array(texts))
    assert [len(x) for x in sets] == [len(shingles(t)) for t in texts]
    assert sets[0].tolist() == sets[1].tolist() and all((np.diff(x) > 0).all() for x in sets)


@pytest.mark.parametrize("crowd", [16, 0])
def test_similar_documents(spark, monkeypatch, crowd):
    r = random.Random(21)
    texts = similar_texts(r, 14)
    rows = [(1000 - k, t, "en") for k, t in enumerate(texts)]
    rows += [(2000, None, "en"), (2001, "", None), (2002, " \t", "en"), (2003, "one", "en"), (2004, "ONE", "en"), (2005, "one two three", "en"), (2006, "x" * 40_000, "en"), (2007, " ".join(f"v{k}" for k in range(9000)), "en")]
    rows += [(2008, rows[-1][1] + " more", "en"), rows[3], rows[3], (None, rows[3][1], "en"), (None, "nobody else", "en"), (5, texts[7] + " end", "en"), (5, "another text of that id", "en"), (6, "x" * 40_000, "en")]
    monkeypatch.setattr(jaccard, "ROUNDS", 1 if not crowd else 2)
    monkeypatch.setattr(jaccard, "TABLE_BITS", 10 if not crowd else 27)
    monkeypatch.setattr(jaccard.links, "__defaults__", (jaccard.PERCENT, crowd))
    found = jaccard.similar_documents(table(spark, rows))
    assert sorted(map(tuple, found.collect()), key=str) == joined(rows)
    assert jaccard.similar_documents(table(spark, rows).limit(0)).count() == 0
