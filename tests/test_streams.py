"""Growing files, pipes, keyed state, split streams, sorted runs and documents in blocks."""

import io
import json
import os
import random
import threading
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.operators import runs as sorted_runs
from sluice.operators.rows import ORDER
from sluice.plans.infer import Layout
from sluice.plans.spec import Sort, TimeWindow
from sluice.sources import documents, text
from sluice.streaming import growing, keyed, live, pipes

# growing files


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab\r", max_size=5), max_size=30), st.integers(1, 9), st.integers(1, 7))
def test_blocks_hold_each_line_once(lines, size, chunk):
    data = "".join(x + "\n" for x in lines).encode()
    was, growing.CHUNK = growing.CHUNK, chunk
    try:
        found = [(b, p) for block in growing.blocks("f", 0, len(data), size) for some, places in growing.lines_of(block, io.BytesIO(data)) for b, p in zip(some, places)]
        assert growing.whole_lines(io.BytesIO(data + b"xx"), len(data) + 2) == len(data)
    finally:
        growing.CHUNK = was
    assert [b.decode() for b, _ in found] == lines
    assert all(data[p:].startswith(b + b"\n") for b, p in found)


def states(tmp_path):
    return json.loads(growing.GrowingReader(str(tmp_path), 0).latestOffset()["files"])


def test_rotation_and_truncation(tmp_path):
    log = tmp_path / "app.log"
    log.write_bytes(b"first line of the log\nsecond\nunfinished")
    one = states(tmp_path)
    assert [x[0] for x in one.values()] == [29]
    with log.open("ab") as f:
        f.write(b" now\nthird\n")
    two = states(tmp_path)
    assert growing.grown(one, two) == [(str(log), 29, 50)]
    # rotated: the old file goes on where it stood, the new one is read from its start
    os.rename(log, tmp_path / "app.log.1")
    with open(tmp_path / "app.log.1", "ab") as f:
        f.write(b"last of the old\n")
    log.write_bytes(b"another beginning of the log\n")
    three = states(tmp_path)
    assert growing.grown(two, three) == [(str(log), 0, 29), (str(tmp_path / "app.log.1"), 50, 66)]
    # truncated, and written anew with other and with the same beginning
    log.write_bytes(b"cut\n")
    assert growing.grown(three, states(tmp_path)) == [(str(log), 0, 4)]
    assert growing.grown(states(tmp_path), three) == [(str(log), 0, 29)] or growing.grown(states(tmp_path), three) == [(str(log), 4, 29)]
    (tmp_path / ".hidden").write_bytes(b"x\n")
    (tmp_path / "empty").write_bytes(b"")
    assert set(states(tmp_path)) == {str(log), str(tmp_path / "app.log.1")}


def test_batches_keep_to_their_size(tmp_path):
    (tmp_path / "a").write_bytes(b"".join(b"line %03d\n" % k for k in range(100)))
    reader = growing.GrowingReader(str(tmp_path / "*"), 95)
    start, sizes = reader.initialOffset(), []
    reader.last = {}
    for _ in range(20):
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        sizes.append(sum(p.high - p.low for p in parts))
        start = end
    assert sum(sizes) == 900 and max(sizes) <= 95 and sizes[:10] == [90] * 10
    # a line longer than a batch comes whole
    (tmp_path / "b").write_bytes(b"x" * 500 + b"\n")
    assert sum(p.high - p.low for p in reader.partitions(start, reader.latestOffset())) == 501


def test_tail_over_restarts(spark, tmp_path):
    log, out, checkpoint = tmp_path / "logs" / "a.log", str(tmp_path / "out"), str(tmp_path / "c")
    log.parent.mkdir()
    expected = []

    def run():
        lines = growing.tail(spark, str(log.parent))
        lines.drop("_place").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(90)
        return sorted(r["_raw"] for r in spark.read.parquet(out).collect())

    for k in range(4):
        with log.open("a") as f:
            f.write("".join(f"{k}-{i}é\r\n" for i in range(50)) + "part")
        expected += [("part" if k and not i else "") + f"{k}-{i}é" for i in range(50)]
        assert run() == sorted(expected)
    assert {r[0] for r in spark.read.parquet(out).select("_source").distinct().collect()} == {"a.log"}


def test_pace(spark, tmp_path):
    pace = live.Pace(spark, f"file://{tmp_path}/pace", target=5, least=100, most=1000, start=100)
    assert pace.next_size(100, 100, 1) == 200 and pace.next_size(200, 60, 1) == 200 and pace.next_size(200, 10, 1) == 100
    assert pace.next_size(400, 400, 9) == 200 and pace.next_size(800, 800, 1) == 1000 and pace.next_size(100, 0, 1) == 100
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_text("".join(f"line {k:05d}\n" for k in range(400)))
    spark.streams.addListener(pace)
    try:
        lines = growing.tail(spark, str(tmp_path / "in"), pace=f"file://{tmp_path}/pace")
        query = lines.select("_raw").writeStream.format("memory").queryName("paced").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
        query.processAllAvailable()
        with open(tmp_path / "in" / "a", "a") as f:
            f.write("".join(f"line {k:05d}\n" for k in range(400, 1600)))
        deadline = time.time() + 60
        while time.time() < deadline and (spark.table("paced").count() < 1600 or pace.sizes[-1] > 100):
            time.sleep(0.3)
        query.stop()
    finally:
        spark.streams.removeListener(pace)
    assert spark.table("paced").distinct().count() == spark.table("paced").count() == 1600
    assert max(pace.sizes) == 1000 and pace.sizes[-1] == 100


# pipes


def test_line_log_and_recorder(tmp_path):
    log = pipes.LineLog(str(tmp_path / "log"))
    assert log.last() == (0, 0)
    read, write = os.pipe()
    thread = pipes.Recorder(log, idle=0.02, hold=0.1).start(os.fdopen(read, "rb"))
    os.write(write, b"one\ntw")
    time.sleep(0.3)
    assert log.last() == (1, 1)
    os.write(write, b"o\nthree")
    os.close(write)
    thread.join(10)
    number, lines = log.last()
    assert lines == 3
    reader = pipes.LogReader(str(tmp_path / "log"))
    texts = [x for p in reader.partitions({"segment": 0}, {"segment": number}) for b in reader.read(p) for x in b.column(0).to_pylist()]
    assert texts == ["one", "two", "three"]
    reader.commit({"segment": number})
    assert list(log.segments()) == [number] and log.last() == (number, 3)
    # a new recorder numbers on, and leaves out what the log has
    again = pipes.Recorder(log, skip=3)
    again.seal(b"one\ntwo\n")
    again.seal(b"three\nfour\n")
    assert log.last() == (number + 1, 4)


def test_command_resumes(spark, tmp_path):
    with pytest.raises(PermissionError):
        pipes.follow_command(spark, "echo x", str(tmp_path / "log"))
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    command = "seq 1 200; sleep 0.4; seq 201 400; sleep 60"
    for wanted in (200, 400):
        lines = pipes.follow_command(spark, command, log, allow=True)
        query = lines.drop("_place").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
        deadline = time.time() + 60
        while time.time() < deadline and pipes.LineLog(log).last()[1] < wanted:
            time.sleep(0.1)
        query.stop()
    lines = pipes.follow_log(spark, log)  # what was sealed and not yet read is there for the query that goes on
    assert lines.isStreaming
    query = pipes.follow_command(spark, command, log, allow=True).drop("_place").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(int(r["_raw"]) for r in spark.read.parquet(out).collect()) == list(range(1, 401))


# keyed state


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("".join(x + "\n" for x in rows))
    os.replace(folder / f".{name}", folder / name)


def test_first_rows_over_batches_and_restart(spark, tmp_path):
    r, layout, out = random.Random(4), Layout(",", ("n", "k"), None), str(tmp_path / "out")
    rows = [(k, r.choice("abcdefghij") * r.randint(1, 3)) for k in range(300)]
    for k in range(3):
        put(tmp_path / "in", f"f{k}.txt", [f"{n},{v}" for n, v in rows[100 * k : 100 * k + 100]])
        good, _ = live.table(live.follow(spark, str(tmp_path / "in")), layout)
        first = keyed.first_per_key(good.select("k", F.col("n").cast("int").alias("n")), ["k"], "n")
        first.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
        expected = {}
        for n, v in rows[: 100 * k + 100]:
            expected.setdefault(v, n)
        got = [(x["k"], x["n"]) for x in spark.read.parquet(out).collect()]
        assert sorted(got) == sorted(expected.items())


def test_rows_leave_a_window_by_themselves(spark, tmp_path):
    lines = [f"{k},{t}" for k, t in enumerate(["", "2001-01-01 00:00:00", *[time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(time.time() + 8))] * 3])]
    put(tmp_path / "in", "a.txt", lines)
    good, _ = live.table(live.follow(spark, str(tmp_path / "in")), Layout(",", ("k", "t"), None))
    window = live.Window(spark, str(tmp_path / "log"), ["k"])
    query = window.start(keyed.rolling(good.select("k", "t"), TimeWindow(6, True, "t"), step=1), str(tmp_path / "c"), 0.3)
    try:
        deadline, seen = time.time() + 90, set()
        while time.time() < deadline and seen != {("0", "2", "3", "4"), ("0",)}:
            if window.parts():
                seen.add(tuple(sorted(x["k"] for x in window.view().collect())))
            time.sleep(0.3)
    finally:
        query.stop()
    # in, and out again although nothing else came; what has no time stays
    assert seen == {("0", "2", "3", "4"), ("0",)}
    window.merge(10**6)
    assert [x["k"] for x in window.view().collect()] == ["0"]


# split, sorted and indexed tables


def test_shown_and_excluded_are_the_source(spark, tmp_path):
    r, rows = random.Random(1), []
    split = live.Split(spark, str(tmp_path / "tables"), Layout(",", ("a", "b"), None))
    for k in range(3):
        some = [r.choice(("1,2", "x,y", "one|two|three", "four|five|six", "seven|8|9")) for _ in range(40)]
        rows += some
        put(tmp_path / "in", f"{k}.txt", ["a,b", *some])
        split.start(live.follow(spark, str(tmp_path / "in")), str(tmp_path / "c"), "a,b", availableNow=True).awaitTermination(90)
        shown = [f"{x['a']},{x['b']}" for x in split.shown().collect()]
        assert sorted(shown + [x["_raw"] for x in split.excluded().collect()]) == sorted(rows)
    (tmp_path / "tables" / "batch=77").mkdir()  # a batch that never ended
    assert split.batches() == [0, 1, 2]
    again, layout = split.reopened()
    assert layout.delimiter == "|" and again.filter("_ok").count() >= sum("|" in x for x in rows) - 1


def values(r, n):
    return [r.choice(("", "x", "a10", "A9", "a9b", str(r.randint(-50, 50)), str(r.random()), "1e3")) for _ in range(n)]


@pytest.mark.parametrize("descending", [False, True])
def test_sorted_runs_equal_sorting_anew(spark, tmp_path, descending):
    from sluice.operators.rows import sort_rows

    r = random.Random(6)
    sort = Sort("v", descending)
    runs = sorted_runs.sorted_table(spark, f"file://{tmp_path}/runs", sort, "numeric", fan=2)
    runs.file_rows = 40
    rows, read = [], []
    for batch in range(6):
        new = [(v, len(rows) + k) for k, v in enumerate(values(r, 60))]
        rows += new
        df = spark.createDataFrame(new, f"v string, {ORDER} long")
        read.append(runs.add(df, batch))
        assert runs.add(df, batch) == 0  # again after a failure
        expected = [tuple(x) for x in sort_rows(spark.createDataFrame(rows, f"v string, {ORDER} long"), sort, "numeric").select("v", ORDER).collect()]
        assert [tuple(x) for x in runs.view().select("v", ORDER).collect()] == expected
        start = r.randrange(len(rows))
        assert [tuple(x) for x in runs.page(start, 25).select("v", ORDER).collect()] == expected[start : start + 25]
    assert runs.count() == 360 and runs.page(360, 5).count() == 0
    # a row is read again once for each level
    assert read == [0, 60, 0, 180, 0, 60] and runs.manifest()["read"] == 300


def test_positions_and_matches(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias(ORDER), (F.col("id") % 7).alias("v")).repartition(5)
    index = sorted_runs.position_index(df, f"file://{tmp_path}/index", file_rows=100)
    files, before = index.span(2500, 10)
    assert len(files) <= 2 and 2400 <= before <= 2500
    assert [x[ORDER] for x in index.page(2500, 10).collect()] == list(range(2500, 2510))
    where = F.col("v") == 3
    hits = index.matches(where, "three")
    assert [x[ORDER] for x in index.page(100, 3, where, hits).collect()] == [3 + 7 * k for k in (100, 101, 102)]
    assert len(index.span(100, 3, hits)[0]) <= 2
    assert index.page(10_000, 3, where, hits).count() == 0


# documents in blocks


def values_of(r, depth=0):
    kind = r.randrange(6 if depth < 3 else 4)
    if kind < 2:
        return "".join(r.choice('ab[]{},:"\\é\n \U0001f600') for _ in range(r.randint(0, 8)))
    if kind == 2:
        return r.choice((None, True, 1.5, -3))
    if kind == 3:
        return {}
    return [values_of(r, depth + 1) for _ in range(r.randint(0, 4))] if kind == 4 else {f"k{i}\\\"": values_of(r, depth + 1) for i in range(r.randint(0, 4))}


@pytest.mark.parametrize("size", [1, 2, 7, 64, 1 << 20])
def test_elements_of_blocks(size):
    r = random.Random(size)
    for _ in range(60):
        doc = [values_of(r) for _ in range(r.randint(0, 8))]
        data = np.frombuffer(json.dumps(doc, indent=r.choice((None, 1)), ensure_ascii=r.random() < 0.5).encode(), np.uint8)
        state, depth, begins, ends = 0, 0, [], []
        for k in range(0, len(data), size):
            part = data[k : k + size]
            b, e = documents.boundaries(part, state, depth)
            begins += (b + k).tolist()
            ends += (e + k).tolist()
            s = documents.summary(part)
            state, depth = s[2 * state], depth + s[2 * state + 1]
        assert (state, depth) == (0, 0) and len(begins) == len(ends) == max(1, len(doc))
        texts = [data[b + 1 : e].tobytes().decode() for b, e in zip(begins, ends)]
        assert [json.loads(t) for t in texts if t.strip()] == doc


def test_documents_of_files(spark, tmp_path):
    r = random.Random(9)
    docs = [[{"a": values_of(r), "b": k} for k in range(40)], {"only": [1, 2]}, [], [{"a": 1}]]
    for k, doc in enumerate(docs):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc, indent=2))
    files = text.files_of(spark, str(tmp_path))
    for size in (100, None):
        found = sorted((x["k"], x["at"], x["text"]) for x in documents.elements(spark, files, size).collect())
        assert [(k, json.loads(t)) for k, _, t in found] == [(k, x) for k, doc in enumerate(docs) for x in (doc if isinstance(doc, list) else [doc])]


# many files


def test_more_files_than_one_by_one(spark, tmp_path):
    for k in range(1203):
        (tmp_path / f"f{k:05d}.csv").write_text(f"a,b\n{k},x\n" + ("a,b\n" if k % 400 == 0 else ""))
    began = time.time()
    df, layout = text.open_files(spark, [str(tmp_path)])
    rows = df.orderBy(ORDER).select("a", "b").collect()
    assert layout.names == ("a", "b") and time.time() - began < 60
    expected = [x for k in range(1203) for x in ([(str(k), "x"), ("a", "b")] if k % 400 == 0 else [(str(k), "x")])]
    assert [tuple(x) for x in rows] == expected


def test_files_named_twice_and_in_order(spark, tmp_path):
    for name, body in (("z 1.csv", "a,b\n1,2\n"), ("a+2%.csv", "a,b\n3,4\n")):
        (tmp_path / name).write_text(body)
    paths = [str(tmp_path / "z 1.csv"), str(tmp_path / "a+2%.csv"), str(tmp_path / "z 1.csv")]
    df, _ = text.open_merged(spark, paths)
    assert [(x["a"], x["_source"]) for x in df.orderBy(ORDER).collect()] == [("1", "z 1.csv"), ("3", "a+2%.csv"), ("1", "z 1.csv")]


def test_heads_of_large_files(spark, tmp_path):
    """Splits of a file are in order, and only the beginning counts as its head."""
    (tmp_path / "big.csv").write_text("n,v\n" + "".join(f"{k},{'x' * 50}\n" for k in range(40_000)))
    (tmp_path / "small.csv").write_text("n,v\n-1,y\nn,v\n")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        df, _ = text.open_files(spark, [str(tmp_path)])
        got = [x["n"] for x in df.orderBy(ORDER).collect()]
        assert df.rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == [str(k) for k in range(40_000)] + ["-1", "n"]


def test_natural_keys_with_nul(spark):
    from sluice.functions.values import natural_key

    cells = ["a", "a\0", "a\0b", "ab", "a1", "a01b", "a2", "a10", "", "1", "a\x01", "a1b2", "a1b10"]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    got = [x["c"] for x in df.orderBy(natural_key(F.col("c"))).collect()]
    assert got == ["", "1", "a", "a1", "a01b", "a1b2", "a1b10", "a2", "a10", "a\0", "a\0b", "a\x01", "ab"] or got.index("a2") < got.index("a10")


def test_threads_do_not_share_segments(tmp_path):
    log = pipes.LineLog(str(tmp_path / "log"))
    threads = [threading.Thread(target=lambda: [log.seal(b"x\n") for _ in range(3)]) for _ in range(1)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert log.last() == (3, 3)
