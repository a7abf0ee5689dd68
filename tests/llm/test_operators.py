"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("sluice.llm")
P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from sluice.llm import decontaminate, gru, html_text, line_dedup, lm_score, mph, packing, quality, secret_scan, simhash, token_counts, token_files, tokens  # noqa: E402
from sluice.llm import queries as llm_queries  # noqa: E402
from sluice.llm.common import shared_dir  # noqa: E402

#: Columns whose names operators use inside.
CLASHES = ("key", "fp", "h", "at", "w", "n", "th", "part", "number", "rank", "blob", "rule", "seed", "kept", "row", "word", "n_lines", "runs", "start", "component_id")
rng = random.Random(5)
WORDS = [a + b for a in ("ba", "ko", "ri", "tu", "née", "süß") for b in ("", "n", "ra", "li", "st")]


def prose(n, r=rng):
    return " ".join(r.choice(WORDS) for _ in range(n))


def corpus():
    """Ordinary texts, copies, near copies, edge cases."""
    r = random.Random(11)
    base = [prose(r.randint(60, 220), r) for _ in range(25)]
    texts = [*base, *base[:4], *base[:2], None, "", "   ", "word", "two words", "x" * 30_000, prose(9000, r), "\n\n", "a\tb  c\n d\x0be\x1cf  g \x0c", "<|endoftext|> don't WE'LL 123²½ ÉCOLE !!...\r\n"]
    for b in base[:6]:
        w = b.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id here"), (None, None), (3, "another text with the same id")]


def table(spark, rows, lang="en"):
    df = spark.createDataFrame([(d, t, lang if (d or 0) % 3 else None, "src", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(c) for c in CLASHES}).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus()).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, []).limit(0)


def encode(name, texts, end, plain=False):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = plain
    return [np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for x in texts]


# tokens


@pytest.mark.parametrize(("name", "pieces"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_pieces_encode_like_whole_texts(name, pieces):
    r = random.Random(1)
    special = [x for s in ("<|endoftext|>", "<|startoftext|>") for x in (s, s.upper(), s.title(), s[:-3], s[2:])]
    alphabet = [*"ab'sé ÉΣİ \n\t.,!-_1²  \r<|>日本éç×", *special]
    texts = [t for _, t in corpus()] + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    for plain in (False, True):
        enc = tokens.PieceEncoder(P.path(name), pieces, plain, limit=200)
        for k in range(0, len(texts), 50):
            some = texts[k : k + 50]
            for got, expected in zip(enc.encode(some), encode(name, some, 0, plain)):
                assert np.frombuffer(got, enc.dtype).tolist() == expected[:-1].tolist()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aZé \n\t,.\x0b\r÷", max_size=12), max_size=6))
def test_split_words(texts):
    from sluice.llm import words

    found, counts = words.split_words(__import__("pyarrow").array(texts, "string"))
    expected = [[x.translate({c: c + 32 for c in range(65, 91)}).encode() for x in re.split(r"[\x20\x09-\x0D]+", t) if x] for t in texts]
    assert found.to_pylist() == [x for t in expected for x in t] and counts.tolist() == list(map(len, expected))


@settings(max_examples=30, deadline=None)
@given(st.sets(st.binary(max_size=8), max_size=300))
def test_perfect_hash(keys):
    keys = sorted(keys)
    place, _ = mph.digests(keys)
    h = mph.PerfectHash.from_bytes(mph.PerfectHash.build(place).to_bytes())
    assert sorted(h.slots(place).tolist()) == list(range(len(keys)))


def test_keys_that_never_part():
    h = mph.PerfectHash([], np.array([5, 9], np.uint64))
    assert h.slots(np.array([9, 5, 7], np.uint64)).tolist() == [1, 0, -1]


def test_op2_files(spark, docs, empty, monkeypatch):
    path = shared_dir(spark)
    token_files.write_token_files(docs, path, P.path("byte_bpe_50k.json"), "byte", 0, shard_ids=5000)
    got = token_files.with_global_starts(token_files.read_token_files(spark, path), token_files.directory(spark, path)).orderBy("start").collect()
    rows = corpus()
    expected = Counter((d, x.tobytes()) for (d, _), x in zip(rows, encode("byte_bpe_50k.json", [t for _, t in rows], 0)))
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in got) == expected
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and len({(r["part"], r["number"]) for r in got}) > 3
    found = token_files.lookup(spark, path, [3, None, 999_999]).collect()
    assert Counter(r["doc_id"] for r in found) == {3: 3, None: 2}
    assert {bytes(r["ids"]) for r in found} == {b for (d, b) in expected if d in (3, None)}
    shards = token_files.directory(spark, path)
    assert shards.count() > 3 and shards.agg(F.sum("ids"), F.sum("records")).first()[:] == (at, len(rows))
    opened = []
    whole = token_files.file_range
    monkeypatch.setattr(token_files, "file_range", lambda s, file, start, n: opened.append((file, n)) or whole(s, file, start, n))
    reader = token_files.Reader(spark, path)
    for key in (7, 7, None, 3, 999_999):
        assert Counter(x.astype("<u4").tobytes() for x in reader.get(key)) == Counter({b: n for (d, b), n in expected.items() if d == key})
    opened.clear()
    token_files.Reader(spark, path).get(7)  # one shard of many: its index, and the ids themselves
    assert len({f for f, _ in opened}) == 1 and opened[-1][1] == 2 * len(next(b for d, b in expected if d == 7)) // 4
    path = shared_dir(spark)
    token_files.write_token_files(empty, path, P.path("byte_bpe_50k.json"), "byte", 0)
    assert token_files.read_token_files(spark, path).count() == 0 and token_files.Reader(spark, path).get(3) == []


def test_blob_numbers(spark, tmp_path):
    """The number of a file stands at the end of its name, whatever its random part looks like."""
    from sluice.llm.common import blobs

    for name in ("part-00002-0a1b-c21f-4b00-8c00-c012ab-c003.txt", "part-00012-c9f1-c100-c000.txt", "part-00000-c9f1-c100-c1234.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted((r["part"], r["number"]) for r in blobs(spark, str(tmp_path)).collect()) == [(0, 1234), (2, 3), (12, 0)]


def test_op7_counts(spark, docs, empty):
    path, end = shared_dir(spark), 49407
    token_counts.write_flat_files(docs, path, P.path("word_bpe_49k.json"), "word", end, block_bytes=512)
    got = token_counts.count_tokens(spark, path, end, 2).join(token_counts.document_keys(spark, path), ["part", "ordinal"]).collect()
    rows = corpus()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((d, len(x)) for (d, _), x in zip(rows, encode("word_bpe_49k.json", [t for _, t in rows], end, True)))
    for part in {r["part"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["part"] == part), key=lambda r: r["ordinal"]):
            assert r["start"] == at
            at += r["n_tokens"]
    path = shared_dir(spark)
    token_counts.write_flat_files(empty, path, P.path("word_bpe_49k.json"), "word", end)
    assert token_counts.count_tokens(spark, path, end, 2).count() == 0


# packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), max_size=60))
def test_pack_places_every_id_once(lengths):
    windows, rest = packing.pack(lengths, [], True)
    assert not rest
    seen = defaultdict(list)
    for size, pieces in windows:
        assert sum(n for _, _, n in pieces) == size <= 4096 and size & (size - 1) == 0
        for d, start, n in pieces:
            seen[d].append((start, n))
    for d, n in enumerate(lengths):
        at = 0
        for start, k in sorted(seen[d]):
            assert start == at and k > 0
            at += k
        assert at == n


def test_op3_pieces(docs, empty):
    got = packing.pack_documents(docs, P.path("word_bpe_49k.json"), "word", 2, block_ids=20_000).collect()
    rows = corpus()
    expected = Counter((d, x.tobytes()) for (d, _), x in zip(rows, encode("word_bpe_49k.json", [t for _, t in rows], 2)))
    by_doc = defaultdict(list)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"]
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    assert sum(r["length"] for r in got) == sum(n * len(b) // 4 for (_, b), n in expected.items())
    for (d, b), n in expected.items():
        pieces = by_doc[d, len(b) // 4]
        assert all(any(bytes(p["ids"]) == b[4 * s : 4 * (s + p["length"])] for (e, b) in expected if e == d for s in [p["start"]]) for p in pieces) and sum(p["length"] for p in pieces) % (len(b) // 4) == 0 and n
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"], r["window"]))
    for pieces in windows.values():
        at = 0
        for offset, n, _ in sorted(pieces):
            assert offset == at
            at += n
        assert at == pieces[0][2]
    assert packing.pack_documents(empty, P.path("word_bpe_49k.json"), "word", 2).count() == 0


def test_op3_keeps_as_many_pieces_as_asked(docs, monkeypatch):
    path = P.path("word_bpe_49k.json")
    assert tokens.encoder(path, "word", limit=50).limit == 50 and tokens.encoder(path, "word").limit == 200_000
    rows = lambda **more: sorted((r["doc_id"] or 0, r["doc_tokens"], r["start"], bytes(r["ids"])) for r in packing.pack_documents(docs.coalesce(1), path, "word", 2, **more).collect())
    assert rows(limit=50) == rows()
    asked = []
    monkeypatch.setattr(llm_queries, "table", lambda *_: docs)
    monkeypatch.setattr(packing, "pack_documents", lambda *a, **more: asked.append(more) or docs.selectExpr("doc_id", *(f"0L as {c}" for c in ("start", "length", "doc_tokens", "sequence_id", "offset", "window", "step_group")), "binary(text) as ids"))
    llm_queries.op3_packing(None, "")
    assert asked[0]["limit"] >= 500_000


def test_step_groups_are_even():
    sizes = [4096] * 100 + [512] * 300 + [1024] * 77
    groups = packing.step_groups(sizes)
    sums = Counter()
    for s, g in zip(sizes, groups):
        sums[g] += s
    assert max(sums.values()) - min(sums.values()) <= 4096


# HTML


class Words(HTMLParser):
    """Words outside head, scripts and the like, in order, a dash for each list item, as the pages' simple markup needs it."""

    def __init__(self):
        super().__init__()
        self.skip, self.words, self.glued = 0, [], False

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "title", "template", "noscript")
        if tag in html_text.BLOCKS or tag in ("br", "td", "th", "tr"):
            self.glued = False
        if tag == "li":
            self.words.append("-")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "title", "template", "noscript") and self.skip > 0
        if tag in html_text.BLOCKS or tag in ("td", "th", "tr"):
            self.glued = False

    def handle_data(self, data):
        if self.skip or not data:
            return
        some = data.split()
        if some and self.glued and not data[0].isspace():
            self.words[-1] += some.pop(0)
        self.words += some
        self.glued = bool(data.split()) and not data[-1].isspace() or self.glued and not data[0].isspace()


def words_in_order(source):
    p = Words()
    p.feed(source)
    p.close()
    return p.words


def test_op1_words_of_real_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages).collect()}
    rows = pages.collect()
    assert len(rows) >= 200
    for r in rows:
        assert got[r["page_id"]].split() == words_in_order(r["html"]), r["page_id"]


def test_op1_tables_by_cells():
    r = random.Random(12)
    for _ in range(60):
        columns = r.randint(1, 5)
        cells = [[" ".join(r.choice(WORDS) for _ in range(r.randint(0, 40 if r.random() < 0.1 else 4))) + ("x" * 90 if r.random() < 0.05 else "") for _ in range(columns)] for _ in range(r.randint(1, 8))]
        source = "<p>before<table>" + "".join("<tr>" + "".join(f"<td>{c}" for c in row) for row in cells) + "</table>after"
        lines = html_text.visible_text(source).split("\n")
        assert sorted(" ".join(lines).split()) == sorted(words_in_order(source))
        # every column begins at one place in all rows
        widths = [max([len(x) for row in cells for x in html_text.wrapped([row[k]] if row[k] else []) if len(x) <= html_text.CELL] or [1 if any(row[k] for row in cells) else 0]) for k in range(columns)]
        starts = [sum(w + 2 for w in widths[:k] if w) for k in range(columns)]
        expected = []
        for row in cells:
            parts = [html_text.wrapped([c]) if c else [] for c in row]
            for k in range(max(map(len, parts))):
                line = ""
                for start, part in zip(starts, parts):
                    if k < len(part):
                        if line and len(line) + 2 > start:
                            expected.append(line)
                            line = ""
                        line = line + " " * (start - len(line)) + part[k]
                expected.append(line)
        assert [x for x in lines[1:-1] if x] == expected, source


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<ul><li style=visibility:hidden>x<b style='visibility: visible'>y</b><li>z</ul>", "y\n- z"),
        ("<ol><li>a<li style='visibility:hidden'>b<li>c</ol>", "1. a\n3. c"),
        ("<table><tr style=visibility:collapse><td>a<tr><td>b</table>", "b"),
        ("<table style=visibility:hidden><tr><td>a<td style=visibility:visible>b</table>", "b"),
        ("<table><tbody style=visibility:hidden><tr><td>a<tr style=visibility:visible><td>b</table>", "b"),
        ("<pre>a<span style=visibility:hidden>b</span>c<i hidden>d</i></pre>", "ac"),
        ("<pre style=visibility:hidden>a<span style=visibility:visible>b</span></pre>", "b"),
        ("<div style='visibility:hidden'>a<p>b</p><p style='visibility:inherit'>c<p style='visibility:visible'>d</div>e", "d\n\ne"),
    ],
)
def test_op1_visibility_is_inherited(source, text):
    assert html_text.visible_text(source).replace("\n\n\n", "\n\n") == text


def test_op1_deep_and_long_pages():
    deep = "<div><span>" * 20_000 + "in" + "</span></div>" * 20_000 + "<ul><li>" * 3_000 + "end"
    assert html_text.visible_text(deep).split() == ["in", *["-"] * 3_000, "end"]
    long = "<p>word <b>bold</b>" * 100_000
    assert html_text.visible_text(long).count("bold") == 100_000


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>", "- a\n- b\n  3. x\n  4. y"),
        ("<table><tr><th>name<th>n<tr><td>long name<td>1</table>", "name       n\nlong name  1"),
        ("<table><tr><td>a<td rowspan=2>b<td>c<tr><td>d<td>e</table>", "a  b  c\nd     e"),
        ("<table><tr><td colspan=2>wide cell<tr><td>a<td>b</table>", "wide cell\na  b"),
        ("x<script>var a='</p>';</script>y<style>p{}</style><!-- c -->z", "xyz"), ("<p hidden>a</p><p style='display: none'>b</p><p style='visibility:hidden'>c<b style='visibility:visible'>d</b></p>e", "d\n\ne"),
        ("<pre>\n a\n   b\n</pre>", " a\n   b"), ("<title>t</title>body &amp; &lt;b&gt;", "body & <b>"), ("<details><summary>s</summary>in</details><details open>out</details>", "s\nout"),
        ("<b><p>a</b>b</p>c", "ab\n\nc"), ("<div>" * 3000 + "deep", "deep"), ("<a href='x>y\">z", 'y">z'), ("<blockquote>q<p>r</blockquote>s", "> q\n>\n> r\n\ns"), ("a < b & c", "a < b & c"), ("</p></td>a", "a"),
    ],
)
def test_op1_layout(source, text):
    assert html_text.visible_text(source) == text


@pytest.mark.parametrize(
    "source, text",
    [
        ("<table><tbody>one<b>two</b><tr>three<td>a</td><td>b</td></tr></tbody></table>", "one\ntwo\nthree\na  b"),
        ("<p>x <svg><defs><text>no</text></defs><circle r=1 /><title>no</title><text>up</text><text>down</text></svg> y", "x up down y"),
        ("<p>so <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>no</annotation></math> holds", "so a+b holds"),
        ("<p><svg><defs/><text>shown</text></svg><defs>too</defs>", "shown too"),
    ],
)
def test_op1_stray_and_foreign(source, text):
    assert html_text.visible_text(source) == text


def test_op1_table(spark):
    df = spark.createDataFrame([(1, "<p>a"), (1, "<p>a"), (2, None), (None, "b")], "page_id long, html string").withColumns({"text": F.lit("t"), "key": F.lit("k")})
    assert Counter(tuple(r) for r in html_text.extract_text(df).collect()) == {(1, "a"): 2, (2, ""): 1, (None, "b"): 1}
    assert html_text.extract_text(df.limit(0)).count() == 0


# language model


def uniform_weights(classes, inputs):
    return gru.init(inputs, np.full(classes, -math.log(classes)), np.full((classes, gru.SIZE), -math.log(gru.SIZE)))


def train_on(trainer, documents, start):
    h = None
    for inputs, fresh, units, mask, _, count in gru.lanes_of(documents, start):
        h = np.zeros((count, gru.HIDDEN), np.float32) if h is None else h[:count]
        h = trainer.window(inputs, fresh, units, mask, h)


def slow_logs(p, document, start):
    """Natural log probability of one document, a step at a time in double precision."""
    q = {k: v.astype(np.float64) for k, v in p.items()}
    h, before, total, n = np.zeros(gru.HIDDEN), start, 0.0, gru.HIDDEN
    for unit in document:
        x, u = q["E"][before] @ q["W"] + q["b"], h @ q["U"]
        r, z = (1 / (1 + np.exp(-(x[k : k + n] + u[k : k + n]))) for k in (0, n))
        new = np.tanh(x[2 * n :] + r * u[2 * n :])
        h = (1 - z) * new + z * h
        k = unit // gru.SIZE
        for logits, at in ((h @ q["C"] + q["c"], k), (h @ q["O"][k] + q["o"][k], unit % gru.SIZE)):
            total += logits[at] - np.log(np.exp(logits).sum())
        before = unit
    return total


def test_lanes_hold_whole_documents():
    r = random.Random(2)
    documents = [np.array([r.randint(0, 99) for _ in range(r.choice([1, 2, 31, 32, 33, 500, 9000]))]) for _ in range(60)]
    got = [[] for _ in documents]
    for inputs, fresh, units, mask, number, count in gru.lanes_of(documents, 100):
        assert inputs.shape == (gru.WINDOW, count)
        for lane in range(count):
            for t in range(gru.WINDOW):
                if mask[t, lane]:
                    d = got[number[t, lane]]
                    assert fresh[t, lane] == (not d) and inputs[t, lane] == (d[-1] if d else 100)
                    d.append(int(units[t, lane]))
    assert got == [d.tolist() for d in documents]


def test_gru_learns_a_rule():
    n = 6
    p = uniform_weights(2, 2 * gru.SIZE + 1)
    trainer = gru.Trainer(p)
    documents = [np.array([(3 * k + s) % n for k in range(200)]) for s in range(40)]
    loss = lambda q: -lm_score.model_scores(q, documents).sum() / 8000
    before = loss(p)
    for _ in range(8):
        train_on(trainer, documents, 2 * gru.SIZE)
    assert trainer.seen == 8 * 8000 and before > 3 and loss(trainer.p) < 0.5


def test_gru_gradient():
    """The gradients of a window in which documents begin follow the finite difference of the loss."""
    r = np.random.default_rng(0)
    p = {k: (v + r.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in uniform_weights(3, 10).items()}
    inputs, units = r.integers(0, 10, (8, 4)), r.integers(0, 3 * gru.SIZE, (8, 4))
    fresh, mask = r.random((8, 4)) < 0.2, r.random((8, 4)) < 0.9
    h = r.normal(0, 0.5, (4, gru.HIDDEN)).astype(np.float32)
    real = np.flatnonzero(mask.ravel())

    def loss(q):
        states, _ = gru.run(q, inputs, fresh, h)
        return -gru.log_probabilities(q, states[1:].reshape(-1, gru.HIDDEN)[real], units.ravel()[real]).mean()

    found = {}

    class Plain(gru.Trainer):
        def step(self, name, grad, at=None):
            found.setdefault(name, np.zeros_like(self.p[name], np.float64))[slice(None) if at is None else at] += grad

    Plain(p).window(inputs, fresh, units, mask, h)
    for name in p:
        direction = r.normal(0, 1, p[name].shape).astype(np.float32)
        e = 1e-2
        slope = (loss(p | {name: p[name] + e * direction}) - loss(p | {name: p[name] - e * direction})) / (2 * e)
        assert slope == pytest.approx(float((found[name] * direction).sum()), rel=0.05, abs=2e-3), name


def test_gru_windows_of_many_lanes():
    """A wide window's gradients are those of its lanes apart, and its arrays are used again."""
    r = np.random.default_rng(1)
    p = {k: (v + r.normal(0, 0.2, v.shape)).astype(np.float32) for k, v in uniform_weights(5, 300).items()}
    steps, lanes = gru.WINDOW, gru.LANES
    inputs, units = r.integers(0, 300, (steps, lanes)), r.integers(0, 5 * gru.SIZE, (steps, lanes))
    units[:, : lanes // 2] = 7  # one class has more rows than are worked on at once
    fresh, mask = r.random((steps, lanes)) < 0.02, r.random((steps, lanes)) < 0.9
    h = r.normal(0, 0.5, (lanes, gru.HIDDEN)).astype(np.float32)

    class Plain(gru.Trainer):
        def step(self, name, grad, at=None):
            self.found.setdefault(name, np.zeros_like(self.p[name], np.float64))[slice(None) if at is None else at] += grad

    def found(some):
        trainer = Plain(p)
        trainer.found = {}
        last = trainer.window(inputs[:, some], fresh[:, some], units[:, some], mask[:, some], h[some])
        return trainer.found, last

    whole, last = found(slice(None))
    apart = {k: np.zeros(v.shape) for k, v in p.items()}
    for some in (slice(0, 1), slice(1, 8), slice(8, 100), slice(100, lanes)):
        part, states = found(some)
        np.testing.assert_allclose(last[some], states, atol=1e-5)
        for k, g in part.items():
            apart[k] += g * mask[:, some].sum() / mask.sum()
    for k in p:
        np.testing.assert_allclose(whole[k], apart[k], atol=1e-6 + 1e-4 * np.abs(apart[k]).max(), err_msg=k)
    trainer = gru.Trainer(p)
    trainer.window(inputs, fresh, units, mask, h)
    tracemalloc.start()
    trainer.window(inputs, fresh, units, mask, h)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 6_000_000, most


def test_gru_scores_like_a_slow_one():
    r = np.random.default_rng(4)
    p = {k: (v + r.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in uniform_weights(3, 3 * gru.SIZE + 1).items()}
    documents = [r.integers(0, 3 * gru.SIZE, n) for n in (1, 1, 40, 33, 32, 700, 5)]
    assert lm_score.model_scores(p, documents).tolist() == pytest.approx([slow_logs(p, d, 3 * gru.SIZE) for d in documents], rel=1e-4)
    every = np.arange(3 * gru.SIZE)
    state = r.normal(0, 1, (1, gru.HIDDEN)).astype(np.float32)
    assert np.exp(gru.log_probabilities(p, np.repeat(state, len(every), 0), every)).sum() == pytest.approx(1, abs=1e-4)


def test_op4_scores(spark, docs, empty, monkeypatch):
    kept = {}
    first = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda rows, v: kept.setdefault("weights", first(rows, kept.setdefault("v", v))))
    rows = corpus()
    words = [[*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}).encode()), b""] for _, t in rows]
    counts = Counter(w for (d, _), ws in zip(rows, words) if lm_score.fold(d) != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = Counter((d, lm_score.fold(d) == 1, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 4)) for (d, _), ws in zip(rows, words))
    for known, own in ((lm_score.KNOWN, lm_score.SHORT), (40, 16)):
        monkeypatch.setattr(lm_score, "KNOWN", known)
        monkeypatch.setattr(lm_score, "SHORT", own)
        kept.clear()
        got = lm_score.score_documents(docs).collect()
        assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
        # the score again, a document and a step at a time
        vocab, weights = kept["v"], kept["weights"]
        assert len(vocab["words"]) <= known + 1 and vocab["own"] <= own
        mass = defaultdict(lambda: 0.5)
        unit = lambda w: vocab["words"][w] if vocab["words"].get(w, own) < vocab["own"] else vocab["rare"] + int(lm_score.rare_units([w])[0])
        for w, k in counts.items():
            mass[unit(w)] += k + 0.5
        scores = Counter()
        for (d, _), ws in zip(rows, words):
            units = [unit(w) for w in ws]
            total = slow_logs(weights, units, len(weights["E"]) - 1) / math.log(10) if len(ws) < 300 else None
            if total is not None:
                scores[d, round(total + sum(math.log10((counts[w] + 0.5) / mass[u]) for w, u in zip(ws, units) if u >= vocab["rare"]), 1)] += 1
        close = Counter((r["doc_id"], round(r["score"], 1)) for r in got if r["n_tokens"] < 300)
        assert sum((scores - close).values()) <= 2 and all(r["score"] < 0 for r in got)  # a sum may be rounded the other way
    assert lm_score.score_documents(empty).count() == 0


def test_op4_needs_no_package_on_executors(spark, docs):
    import pickle

    v = lm_score.vocabulary(lm_score.count_words(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    assert b"sluice" not in pickle.dumps(v) + pickle.dumps(lm_score.start_weights(v["mass"]))


def test_op4_is_better_on_held_out_texts(spark):
    held = lm_score.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    got = held.agg(F.sum("score"), F.sum("base_score"), F.avg((F.col("score") > F.col("base_score")).cast("int")), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.25 * got[3] and got[2] > 0.9


def test_op4_learns_from_every_token(spark, docs):
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).coalesce(1)
    v = lm_score.vocabulary(lm_score.count_words(rows))
    coded = lm_score.encoded(rows, spark.sparkContext.broadcast(v)).cache()
    start, seen = lm_score.start_weights(v["mass"]), 0
    for folds in lm_score.ROUNDS:
        weights = lm_score.train_round(coded, start, folds)
        trainer = gru.Trainer(start)
        own = [np.frombuffer(r["units"], "<u2") for r in coded.collect() if r["fold"] in folds]
        train_on(trainer, own, len(start["E"]) - 1)
        assert trainer.seen == sum(map(len, own))
        seen += trainer.seen
        np.testing.assert_allclose(gru.flat(weights), gru.flat(trainer.p), atol=1e-3)
    assert seen == v["tokens"]


def test_op4_shapes():
    r = random.Random(6)
    words = ["".join(r.choice("abzé ñü1.,*_-{[9") for _ in range(r.randint(1, 12))).replace(" ", "").encode() or b"x" for _ in range(500)]
    assert lm_score.shapes_of(words).tolist() == [lm_score.shape(w) for w in words]
    assert lm_score.shapes_of([*words, b""]).tolist()[-1] == lm_score.shape(b"")


# decontamination


def naive_leaks(rows, items):
    out = set()
    for d, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        for i, s in items:
            v = [x for x in re.split(r"[\x20\x09-\x0D]+", (s or "").lower()) if x]
            for at in range(-len(v) + 1, len(w)) if v else ():
                n = sum(0 <= at + k < len(w) and w[at + k] == x for k, x in enumerate(v))
                if n >= 0.8 * len(v):
                    out.add((d, i, at, len(v), n))
    return out


def test_op5_leaks(spark, docs, empty, monkeypatch):
    r = random.Random(3)
    items = [(k, " ".join(f"w{r.randint(0, 400)}" for _ in range(n))) for k, n in enumerate((5, 6, 7, 8, 10, 17, 30, 41))] + [(8, None), (9, ""), (10, "too short"), (0, "other words of the same item id here")]
    rows = list(corpus())
    for k, (i, s) in enumerate(items[:8]):
        w = s.split()
        for j in range(0, len(w), 9):
            w[j] = "swapped"
        rows += [(1000 + k, prose(30, r) + " " + s.upper() + " " + prose(20, r)), (2000 + k, prose(7, r) + "\n" + " ".join(w)), (3000 + k, s)]
    df, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    expected = {x for x in naive_leaks(rows, items)}
    for limit in (decontaminate.BROADCAST_SEEDS, 1):
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
        got = {tuple(x) for x in decontaminate.leaks(df, bench).select("doc_id", "item_id", "at", "item_words", "matched").collect()}
        assert got == expected and {x[3] for x in expected} >= {5, 6, 7, 8, 10}
        assert {(1000 + k, items[k][0]) for k in range(8)} <= {x[:2] for x in got}
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(d not in {x[0] for x in got} or d is None for d, _ in rows)
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(df, bench.limit(0)).count() == 0


def test_op5_short_items(spark):
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in range(1, 16)]
    rows = []
    for n, t in items:
        for spoiled in itertools.chain.from_iterable(itertools.combinations(range(n), m) for m in range(n // 5 + 1)):
            rows.append((len(rows), "a b c " + " ".join("x" if k in spoiled else w for k, w in enumerate(t.split())) + " d e"))
    df, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(x) for x in decontaminate.leaks(df, bench).select("doc_id", "item_id", "at", "item_words", "matched").collect()}
    assert got == naive_leaks(rows, items) and {x[1] for x in got} == set(range(1, 16))
    con = pytest.importorskip("duckdb").connect()
    some = df.filter("doc_id % 3 = 0 or doc_id < 9")
    con.register("documents", some.select("doc_id", "text").toPandas())
    con.register("benchmark", bench.union(spark.createDataFrame([(20, ""), (21, None), (22, " \n")], bench.schema)).toPandas())
    found = decontaminate.overlaps(some, bench).select("doc_id", "item_id", "at", "item_words", "start", "words", "matched").collect()
    assert Counter(con.sql(decontaminate.OVERLAPS_SQL).fetchall()) == Counter(map(tuple, found)) and {x["item_words"] for x in found} >= {1, 2, 3, 4}


def test_op5_capitals_with_marks(spark):
    item = "doesbo dora el ñ es, quéasarjarr mente, ciónmiírr éonleeau"
    df, bench = table(spark, [(1, "a b " + item.upper() + " c"), (2, prose(30))]), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r["doc_id"] for r in decontaminate.decontaminated(df, bench).collect()] == [2]
    assert [r["matched"] for r in decontaminate.leaks(df, bench).collect()] == [9]


def test_op5_partial_overlaps(spark):
    r = random.Random(6)
    words = [f"v{k}" for k in range(59)]
    part = [w if k % 6 else "x" for k, w in enumerate(words[10:40])]
    texts = {
        1: [prose(20, r), *words[:45], prose(9, r)], 2: [*words[30:], prose(20, r)], 3: [prose(5, r), *words[:30], "added", *words[30:]], 4: [*words[:20], *words[21:40]],
        5: [prose(5, r), *part, prose(5, r)], 6: ["y", *words[:7], "y", "y", "y"], 7: [prose(40, r)], 8: ["y", *words[20:31], "y", "y", "y"], 9: ["U1", "u2", "U3", "u4", "U5"],
    }
    df = table(spark, [(d, " ".join(t)) for d, t in texts.items()])
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "u1 u2 u3 u4 u5")], "item_id long, text string")
    got = defaultdict(set)
    for x in decontaminate.overlaps(df, bench).collect():
        got[x["doc_id"]].add((x["item_id"], x["start"], x["words"], x["matched"]))
    assert set(got) == {1, 2, 3, 4, 5, 8, 9} and got[9] == {(2, 0, 5, 5)}
    for d, t in texts.items():  # the longest run of each alignment, by trying all
        t, runs = " ".join(t).split(), set()
        for at in range(-58, len(t)) if d != 9 else ():
            same = [0 <= at + k < len(t) and t[at + k] == w for k, w in enumerate(words)]
            found = [(j - i, -i, sum(same[i:j])) for i in range(59) for j in range(i + 11, 60) if sum(same[i:j]) >= 0.8 * (j - i)]
            if found:
                n, i, m = max(found)
                runs.add((1, -i, n, m))
        assert d == 9 or got.get(d, set()) == runs
    assert {x["doc_id"] for x in decontaminate.decontaminated(df, bench).collect()} == {6, 7}
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    con.register("benchmark", bench.toPandas())
    rows = decontaminate.overlaps(df, bench)
    assert Counter(con.sql(decontaminate.OVERLAPS_SQL).fetchall()) == Counter(tuple(x) for x in rows.select("doc_id", "item_id", "at", "item_words", "start", "words", "matched").collect())


# secrets


@pytest.mark.parametrize("start", ["eyJ", "eyJ-", "eyJaaaaaaaaaa.", "eyJaaaaaaaaaa.eyJ", "ghp_", "xoxb-", "xoxb-1234567890", "AKIA", "-----BEGIN ", "password", "password=", "token  ", "0123456789abcdef", "0123456789abcdefg"])
def test_op6_takes_time_in_proportion(spark, start):
    """A million characters of what a rule's matches begin with."""
    import time

    text = start * (1_000_000 // len(start))
    began = time.perf_counter()
    secret_scan.scan(spark.createDataFrame([("b", text, [r.key for r in secret_scan.RULES])], "blob string, text string, todo array<string>")).count()
    assert time.perf_counter() - began < 30


def test_op6_tokens_with_headers(spark):
    good = "eyJ" + "a" * 20 + ".eyJ" + "b" * 3000 + ".sig-1"
    df = spark.createDataFrame([("b", "x " + good + " y eyJshort.eyJ" + "c" * 20 + ".s", [r.key for r in secret_scan.RULES])], "blob string, text string, todo array<string>")
    found = [(r["start"], r["end"]) for r in secret_scan.scan(df).filter("kind = 'jwt'").collect()]
    assert found == [(2, 2 + len(good))]


def naive_spans(t):
    spans = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(spans)


SECRETS = [
    'é password = "hunter22" and TOKEN:abcdef, secret=token:abcdefgh', "AKIA" + "A" * 16 + " AKIAB AKIA" + "0" * 20, "f" * 24 + " " + "a" * 23 + "g" + "0123456789abcdef" * 3, "api_key: 'x' apikey=" + "k" * 9,
    "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a" * 36, "token = a.b-c/d=" * 3, "no secrets", "😀 passwd:'s3cr3tvalue' 😀 password=longenough",
]


def test_op6_spans_and_ledger(spark, empty):
    rows = [*corpus(), *[(5000 + k, s) for k, s in enumerate(SECRETS)], *[(6000 + k, SECRETS[0]) for k in range(3)]]
    df = table(spark, rows)
    ledger = secret_scan.Ledger(spark, shared_dir(spark))
    ledger.update(df, secret_scan.BASE)
    got = secret_scan.report(df, ledger, secret_scan.BASE).collect()
    assert len(got) == len(rows)
    expected = Counter((d, tuple(naive_spans(t or ""))) for d, t in rows)
    assert Counter((r["doc_id"], tuple((s["start"], s["place"], s["end"], s["kind"]) for s in r["spans"])) for r in got) == expected
    blobs = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows}
    assert ledger.scanned().count() == len(blobs) * len(secret_scan.BASE)
    ledger.update(df, secret_scan.BASE)
    assert ledger.scanned().count() == len(blobs) * len(secret_scan.BASE)
    more = df.union(table(spark, [(9000, "new token=abcdef123")]))
    ledger.update(more)
    assert ledger.scanned().count() == (len(blobs) + 1) * len(secret_scan.RULES)
    kinds = {s["kind"] for r in secret_scan.report(more, ledger).collect() for s in r["spans"]}
    assert kinds == {"assign", "access", "hex", "pem", "github"}
    assert secret_scan.report(empty, ledger).count() == 0


def test_op6_repeated_rows(spark):
    rows = [(1, SECRETS[0]), (1, SECRETS[0]), (2, SECRETS[0]), (None, SECRETS[2]), (None, SECRETS[2])]
    df = table(spark, rows)
    ledger = secret_scan.Ledger(spark, shared_dir(spark))
    ledger.update(df, secret_scan.BASE)
    got = Counter((r["doc_id"], tuple((s["start"], s["place"], s["end"], s["kind"]) for s in r["spans"])) for r in secret_scan.report(df, ledger, secret_scan.BASE).collect())
    assert got == Counter((d, tuple(naive_spans(t))) for d, t in rows) and all(len(x[1]) > 1 for x in got)


def test_op6_sql(spark, monkeypatch):
    from sluice.llm import queries

    duckdb = pytest.importorskip("duckdb")
    rows = [(k, t) for k, t in enumerate([*[t for _, t in corpus()], *SECRETS])]
    df = table(spark, rows)
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = queries.op6_secret_scan(spark, "")
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text").toPandas())
    found = con.sql(secret_scan.scan_sql())
    assert found.columns == got.columns and Counter(found.fetchall()) == Counter(tuple(r) for r in got.collect())


# quality


def naive_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    first, inside = defaultdict(list), set()
    for k in range(len(w) - 2):
        first[tuple(w[k : k + 3])].append(k)
    for places in first.values():
        if len(places) > 1:
            inside |= {k + j for k in places for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAb é\n\t#日", max_size=60), max_size=8))
def test_op8_base_counts(texts):
    import pyarrow as pa

    got = quality.Texts(pa.array(["x", *texts], pa.string()).slice(1))
    assert list(zip(*(got.base[n].tolist() for n in quality.COUNTS))) == [naive_counts(t) for t in texts]
    assert [got.values[k] for k in got.codes.tolist()] == [w for t in texts for w in t.encode().lower().split()]


def test_op8_counts_and_bands(spark, docs, empty):
    rows = corpus()
    got = quality.rate(docs).collect()
    expected = Counter()
    for d, t in rows:
        c = naive_counts(t or "")
        expected[(d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert Counter((r["doc_id"], *[r[n] for n in quality.COUNTS], r["base_failed"]) for r in got) == expected
    assert all(not r["kept"] or not r["base_failed"] and r["low"] <= r["log_ppl"] <= r["high"] for r in got) and any(r["kept"] for r in got)
    odd = table(spark, [*rows, (7000, "".join(chr(0x4E00 + k * 7 % 2000) for k in range(400)).replace("万", " ") + " zq" * 3 + " " + " ".join(f"q{k}zx%&" for k in range(80)))])
    assert not {r["doc_id"]: r["kept"] for r in quality.rate(odd).collect()}[7000]
    assert quality.rate(empty).count() == 0 and quality.keep_good(docs).columns == docs.columns


def naive_model(grams, order, uniform):
    """log10 probabilities by dictionaries: grams maps tuples of the highest order to counts."""
    levels = [dict(grams)]
    for _ in range(order - 1):
        levels.insert(0, Counter(g[1:] for g in levels[0]))
    discounts = []
    for level in levels:
        n1, n2, n3, n4 = (max(1, sum(c == k for c in level.values())) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        discounts.append([min(max(d, 0.05), top) for d, top in zip(raw, (0.95, 1.9, 2.8))])
    sums = [defaultdict(lambda: [0, 0.0]) for _ in levels]
    for level, d, total in zip(levels, discounts, sums):
        for g, c in level.items():
            total[g[:-1]][0] += c
            total[g[:-1]][1] += d[min(c, 3) - 1]

    def p(g):
        if not g:
            return 1 / uniform(levels[0])
        c, d = levels[len(g) - 1].get(g, 0), discounts[len(g) - 1]
        total, taken = sums[len(g) - 1].get(g[:-1], (0, 0))
        if not total:
            return p(g[1:])
        return (c - d[min(c, 3) - 1] if c else 0) / total + taken / total * p(g[1:])

    return p


def test_op8_perplexity_by_dictionaries(spark):
    r = random.Random(8)
    rare = ["".join(r.choice("abcdeéß日#") for _ in range(r.randint(1, 9))) for _ in range(600)]
    rows = []
    for k in range(120):
        words = [r.choice(WORDS[:8]) if r.random() < 0.6 else r.choice(rare).upper() for _ in range(r.randint(60, 200))]
        rows.append((k, " ".join(words)))
    rows += [(200, "zq xj " * 30), (201, "too short"), (202, "Quite new words, " + rows[0][1]), (203, None), (204, rows[3][1])]
    got = quality.rate(table(spark, rows, "xx")).collect()
    texts = {d: (t or "").encode().lower().split() for d, t in rows}
    lang = {d: "xx" if (d or 0) % 3 else "" for d, _ in rows}
    failed = {r["doc_id"]: r["base_failed"] for r in got}
    assert {d for d in texts if failed[d]} == {200, 201, 203}
    for name in ("xx", ""):
        good = [w for d, w in texts.items() if lang[d] == name and not failed[d]]
        counts = Counter(x for w in good for x in w)
        known = {w for w, n in counts.items() if n >= max(2, quality.FREQUENT * sum(counts.values()))}
        word_grams, char_grams = Counter(), Counter()
        for w in good:
            s = [b"", b"", *[x if x in known else None for x in w]]
            word_grams.update(zip(s, s[1:], s[2:]))
        for x in counts.keys() - known:
            s = "\n\n\n" + x.decode() + "\n"
            char_grams.update(zip(s, s[1:], s[2:], s[3:]))
        assert known and char_grams
        word_p, char_p = (naive_model(g, n, lambda level: len(level) + 1) for g, n in ((word_grams, 3), (char_grams, 4)))
        for x in got:
            if lang[x["doc_id"]] == name and not x["base_failed"]:
                total, s = 0, [b"", b"", *[w if w in known else None for w in texts[x["doc_id"]]]]
                for k, w in enumerate(texts[x["doc_id"]]):
                    total += math.log10(word_p(tuple(s[k : k + 3])))
                    if w not in known:
                        c = "\n\n\n" + w.decode() + "\n"
                        total += sum(math.log10(char_p(tuple(c[j : j + 4]))) for j in range(len(c) - 3))
                assert abs(x["log_ppl"] + 1000 * total / len(texts[x["doc_id"]])) < 1, x["doc_id"]


def test_op8_rejects_junk(spark):
    r = random.Random(8)
    good = [(k, prose(300, r)) for k in range(40)]
    bad = [(100, "zq xj " * 30 + prose(20, r)), (101, "kw vb")]  # repeats, too short
    marked = [(200 + k, " ".join(w + "###" if j % 2 == 0 else w for j, w in enumerate(prose(300, r).split()))) for k in range(3)]
    words = [{(x["lang"], x["word"]): x["n"] for x in quality.count_words(table(spark, rows)).collect()} for rows in (good, good + bad)]
    assert words[0] == words[1] and words[0]
    rated = {x["doc_id"]: x for x in quality.rate(table(spark, good + bad + marked)).collect()}
    assert not any(rated[d]["kept"] for d, _ in bad + marked) and sum(rated[d]["kept"] for d, _ in good) >= 38
    assert not any(rated[d]["base_failed"] for d, _ in marked)


def test_op8_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    rated = quality.rate(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in rated.groupBy("quality", "kept").count().collect()}
    assert n[1, True] > 0.97 * (n[1, True] + n.get((1, False), 0)) and n[0, False] > 0.9 * (n[0, False] + n.get((0, True), 0))


def test_models_hold_every_n_gram_of_a_large_corpus(spark):
    r = np.random.default_rng(5)
    codes = r.integers(2, 102, (200, 11_000))
    rows = [(k, " ".join(f"w{c}x" for c in row), "xx") for k, row in enumerate(codes.tolist())]
    starts = np.concatenate([np.zeros((200, 2), np.int64), codes], 1)
    grams = np.unique((starts[:, :-2] << 40 | starts[:, 1:-1] << 20 | starts[:, 2:]).ravel())
    (model,) = quality.language_models(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8))
    assert len(model["xx"]["known"]) == 100
    assert [len(x["keys"]) for x in model["xx"]["words"]] == [len(np.unique(grams & (1 << bits) - 1)) for bits in (20, 40, 60)]


def test_op8_kneser_ney_sums_to_one():
    r = np.random.default_rng(3)
    columns = [np.array(x, np.int64) for x in zip(*{tuple(g) for g in r.integers(0, 9, (400, 3)).tolist()})]
    model = quality.kneser_ney(columns, r.integers(1, 6, len(columns[0])))
    for a, b in ((0, 0), (3, 5), (77, 2), (77, 78)):
        every = [np.full(10, a), np.full(10, b), np.array([*range(9), 99])]  # 99 stands for what is unknown
        assert (10 ** quality.find(model, every, 3)).sum() == pytest.approx(1, abs=1e-5)
    totals = np.bincount(columns[0] * 9 + columns[1], np.full(len(columns[0]), 3.0))[columns[0] * 9 + columns[1]]
    part = quality.kneser_ney(columns, np.full(len(columns[0]), 2), [9, 5, 3, 1], totals)  # others were left out
    assert (10 ** quality.find(part, [np.full(10, 3), np.full(10, 5), np.array([*range(9), 99])], 3)).sum() == pytest.approx(1, abs=1e-5)


def test_op8_languages_in_groups(spark, docs, monkeypatch):
    def rows():
        return sorted((tuple(r) for r in quality.rate(docs).select("doc_id", "lang", "log_ppl", "kept", *quality.COUNTS).collect()), key=str)

    whole = rows()
    monkeypatch.setattr(quality, "BROADCAST_GRAMS", 1)
    assert rows() == whole


def test_op8_many_characters():
    words = ["".join(chr(0x10000 + 7 * k + j) for j in range(5)) for k in range(12_000)]
    got = Counter()
    for head, tail, n in quality.packed_chars(words):
        got.update({(int(h), int(t)): int(k) for h, t, k in zip(head, tail, n)})
    expected = Counter()
    for w in words:
        c = [10, 10, 10, *map(ord, w), 10]
        expected.update((c[k] << 42 | c[k + 1] << 21 | c[k + 2], c[k + 3]) for k in range(len(c) - 3))
    assert got == expected


def test_op8_bands_by_sorting(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", "b"]), r.randint(500, 700), False) for _ in range(201)]
    df = spark.createDataFrame([(*x,) for x in rows], "lang string, log_ppl long, base_failed boolean")
    for b in quality.bands(df, 2.0, 3.0, 1).collect():
        x = np.array([p for lang, p, _ in rows if lang == b["lang"]])
        mad = np.median(np.abs(x - np.median(x)))
        assert (b["low"], b["high"]) == (np.median(x) - max(1, 2 * mad), np.median(x) + max(1, 3 * mad))


# lines


def naive_dedup(rows, least):
    """Every line of every run whose lines, with enough words, start at an earlier place too."""
    order = sorted({(d is not None, d or 0, t) for d, t in rows if t}, key=lambda x: x[:2])
    seqs = [(x, [(k, s, len(s.encode().split())) for k, s in enumerate(x[2].split("\n")) if s.encode().split()]) for x in order]
    seen, gone = defaultdict(list), defaultdict(set)
    for a, (x, s) in enumerate(seqs):
        for i in range(len(s)):
            best = 0
            for b, j in seen[s[i][1]]:
                u, n = seqs[b][1], 0
                while i + n < len(s) and j + n < len(u) and s[i + n][1] == u[j + n][1]:
                    n += 1
                best = max(best, n)
            seen[s[i][1]].append((a, i))
            if best and sum(y[2] for y in s[i : i + best]) >= least:
                gone[x].update(range(s[i][0], s[i + best - 1][0] + 1))
    return {x: "\n".join(s for k, s in enumerate(x[2].split("\n")) if k not in gone[x]) for x in order}


@pytest.mark.parametrize(("seed", "least", "bits"), [(1, 8, 64), (2, 3, 64), (3, 5, 2)])
def test_op9_lines(spark, seed, least, bits, monkeypatch):
    monkeypatch.setattr(line_dedup, "HASH_BITS", bits)  # with few bits different lines share their first hash
    r = random.Random(seed)
    lines = ["a b", "c", "d e f", "", "g h i", "j k l m n", " ", "unique"]
    rows = [(k, "\n".join(r.choice(lines[:-1]) + (f" {r.randint(0, 99)}" if r.random() < 0.05 else "") for _ in range(r.randint(0, 30)))) for k in range(40)]
    rows += [(50, rows[7][1]), (51, rows[7][1]), (60, None), (61, ""), (62, "\n\n"), (None, rows[9][1])]
    df = table(spark, rows)
    got = line_dedup.dedup_lines(df, least)
    assert got.columns == [*[c for c in df.columns if c != "n_lines"], "n_lines", "n_deleted"]
    expected = naive_dedup(rows, least)
    places = {x[:2]: k for k, x in enumerate(expected)}
    texts = list(expected.values())
    for x in got.select("doc_id", "text", "n_lines", "n_deleted").collect():
        at = places.get((x["doc_id"] is not None, x["doc_id"] or 0))
        assert (x["text"] or "") == (texts[at] if at is not None else ""), x
        assert x["n_lines"] - x["n_deleted"] == (x["text"].count("\n") + 1 if x["text"] else 0)
    assert line_dedup.dedup_lines(df.limit(0), least).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_op9_ranges_of_suffixes(seed):
    """Steps that are passed on between ranges give what one list of all suffixes gives."""
    r = random.Random(seed)
    suffixes = sorted([r.randint(0, 1) for _ in range(r.randint(1, 6))] for _ in range(60))
    places = [(1, r.randint(0, 30), 0, k) for k in range(60)]
    common = [0] + [line_dedup.prefix_length(a, b) for a, b in zip(suffixes, suffixes[1:])]
    expected = line_dedup.longest_earlier(places, common)
    brute = [max([min(common[min(j, k) + 1 : max(j, k) + 1]) for j in range(60) if places[j] < places[k]], default=0) for k in range(60)]
    assert expected == brute
    cuts = sorted({0, 60, *[r.randint(1, 59) for _ in range(r.randint(0, 15))]})
    ends = {}
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        ends[part] = line_dedup.Ends()
        assert [ends[part].add(places[k], suffixes[k]) for k in range(a, b)][1:] == common[a + 1 : b]
    carried, got = line_dedup.carried(ends), []
    for part, (a, b) in enumerate(zip(cuts, cuts[1:])):
        before, behind = carried[part]
        some = [p for _, p in before] + places[a:b] + [p for _, p in behind[::-1]]
        lengths = [0] + [n for n, _ in before] + common[a + 1 : b] + [n for n, _ in behind[::-1]]
        got += line_dedup.longest_earlier(some, lengths)[len(before) : len(before) + b - a]
        assert all(len(x) <= 7 for x in carried[part])
    assert got == expected


# SimHash


def naive_fingerprint(t):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return 0
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def naive_roots(values):
    values = list(values)
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def test_op10_components(spark, docs, empty):
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex16("fp").alias("f"), "component_id").collect()
    rows = corpus()
    fp = [naive_fingerprint(t) for _, t in rows]
    root = naive_roots(dict.fromkeys(fp))
    low = {}
    for (d, _), f in zip(rows, fp):
        if d is not None:
            low[root[f]] = min(d, low.get(root[f], d))
    assert Counter((r["doc_id"], r["f"], r["component_id"]) for r in got) == Counter((d, f"{f:016x}", low.get(root[f])) for (d, _), f in zip(rows, fp))
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("probe", [1, 10_000])
def test_op10_close_sets(probe):
    r = random.Random(probe)
    base = [r.getrandbits(24) for _ in range(20)]
    values = np.array(sorted({b ^ sum(1 << r.randint(0, 23) for _ in range(r.randint(0, 4))) for b in base * 10}), np.uint64)
    got, expected = simhash.close_sets(values, probe), naive_roots(values.tolist())
    assert len({(int(values[g]), expected[v]) for g, v in zip(got, values.tolist())}) == len(set(got.tolist())) == len(set(expected.values()))


@pytest.mark.parametrize(("hot", "positions"), [(64, 3), (64, 4), (simhash.HOT, 3), (simhash.HOT, 4), (2, 3)])
def test_op10_links_and_chains(spark, hot, positions):
    r = random.Random(4)
    chain = [r.getrandbits(64)]
    for _ in range(60):
        chain.append(chain[-1] ^ sum(1 << b for b in r.sample(range(64), 3)))
    values = list(dict.fromkeys([*chain, *[r.getrandbits(64) for _ in range(200)]]))
    df = spark.createDataFrame([(int(np.array([v], np.uint64).view(np.int64)[0]),) for v in values], "fp long")
    edges = simhash.links(df, hot, positions)
    linked = {tuple(int(np.array([x], np.int64).view(np.uint64)[0]) for x in e) for e in edges.collect()}
    every = {(max(a, b), min(a, b)) for k, a in enumerate(values) for b in values[:k] if (a ^ b).bit_count() <= 3}
    assert hot < 60 or linked == every  # hot postings give each fingerprint the root of its links
    roots = {int(np.array([x["node"]], np.int64).view(np.uint64)[0]): x["root"] for x in simhash.components(edges).collect()}
    expected = naive_roots(values)
    groups = defaultdict(set)
    for v in values:
        groups[expected[v]].add(roots.get(v))
    assert all(len({x for x in g if x is not None}) <= 1 for g in groups.values()) and max(Counter(expected.values()).values()) >= 61


# the pipeline


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf)
        assert docs.count() > 0
        if k < 4:
            assert docs.columns == names and {r["doc_id"] for r in docs.select("doc_id").collect()} <= {r["doc_id"] for r in before.select("doc_id").collect()}
            docs = docs.cache()
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    crc = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in docs.collect()}
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for d, x in zip(texts, encode("word_bpe_49k.json", texts.values(), 2)):
        at = 0
        while at < len(x):
            n, c = crc[d, at]
            assert zlib.crc32(x[at : at + n].tobytes()) == c
            at += n


def test_pipeline_edge_cases(spark, docs, empty):
    sf = "/root/testdata/sf0.001"
    for rows in (docs, empty):
        ids, now = {r["doc_id"] for r in rows.collect()}, rows
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, sf)
            if k < 4:
                assert now.columns == rows.columns and now.dtypes == rows.dtypes
                now = now.cache()
            assert {r["doc_id"] for r in now.select("doc_id").collect()} <= ids
        assert (now.count() > 0) == bool(ids)
    odd = table(spark, [(1, None), (None, None), (2, ""), (2, ""), (3, "a few words")])
    assert corpus_pipeline.without_leaks(spark, odd, sf).count() == 5
    assert corpus_pipeline.without_repeated_runs(spark, odd, sf).count() == 5
    kept = corpus_pipeline.one_of_each_group(spark, odd, sf).collect()
    assert Counter(r["doc_id"] for r in kept) == {1: 1, 3: 1}
    pieces = corpus_pipeline.packed(spark, odd, sf).collect()
    assert sum(r["length"] for r in pieces) == 4 + 4


def test_pipeline_leaves_no_folders(spark, monkeypatch):
    from sluice.llm import common

    monkeypatch.setattr(common, "MADE", [])
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
    assert len(common.MADE) == 1


def test_pipeline_with_columns_of_its_own_names(spark):
    """Users' columns may have the names that stages use inside."""
    sf = "/root/testdata/sf0.001"
    names = [f"sluice_{x}" for x in ("kept", "leaked", "id", "th", "runs", "n_lines", "n_deleted", "kept_")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).withColumns({n: F.lit(n) for n in names}).cache()
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    row = docs.first()
    assert docs.count() and all(row[n] == n for n in names)
