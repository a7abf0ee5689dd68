"""Cells, rows, columns, text, sinks, the command line and streams on small tables."""

import csv
import datetime
import io
import os
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice import cli, queries_sources
from sluice.functions import datetimes, regexes, values
from sluice.operators import columns as cols
from sluice.operators import rows
from sluice.plans.build import build
from sluice.plans.infer import Layout, infer_layout
from sluice.plans.spec import Computed, Filter, QuerySpec, Sort, SpecError, TimeWindow
from sluice.sources import sinks, text
from sluice.streaming import live

PEOPLE = [("Ann", "30", "NYC"), ("Bob", "5", "SF"), ("Cy", "100", "NYC"), ("Dan", "", "LA"), ("Eve", "n/a", "SF")]


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(*p, k) for k, p in enumerate(PEOPLE)], "name string, age string, city string, _ord long").coalesce(1)


def one(spark, expr, *cells):
    df = spark.createDataFrame([(c,) for c in cells], "v string")
    return [r[0] for r in df.select(expr).collect()]


def test_python_patterns(spark):
    p = regexes.translate(r"(?P<request_id>\w+)-(?P=request_id)\Z")
    assert p.names == ("request_id",) and one(spark, F.col("v").rlike(p.flagged), "ab-ab", "ab-cd") == [True, False]
    assert one(spark, regexes.contains(F.col("v"), "é"), "CAFÉ", "cafe", None) == [True, False, False]
    assert one(spark, F.struct(*[c.alias(n) for n, c in regexes.groups_at_start(F.col("v"), r"(?P<a>\d+)(x)?").items()]), "12x", "z1")[0] == ("12", "x")
    with pytest.raises(re.error):
        regexes.translate("(")


def test_first_match_only(spark):
    assert one(spark, regexes.replace_first(F.col("v"), "ms", ""), "100ms,200ms", "x") == ["100,200ms", "x"]
    assert one(spark, regexes.replace_first(F.col("v"), r"(\d)(\d)", r"\2$\1"), "a12 34") == ["a2$1 34"]
    s = regexes.parse_substitution("s/a\\/b/c/gi")
    assert s == regexes.Substitution("a/b", "c", True, True)
    assert regexes.parse_substitution("s|a|b|") == regexes.Substitution("a", "b") and regexes.parse_substitution("sort x") is None


def test_split_json_kv(spark):
    assert one(spark, values.split_part(F.col("v"), ".", 1), "a.b", "a") == ["b", ""]
    assert one(spark, values.json_value(F.col("v"), "a.1.b"), '{"a": [0, {"b": {"c": 1}}]}', "x", "{}") == ['{"c":1}', "", ""]
    assert one(spark, values.key_value(F.col("v"), "k"), "k=1 k=2", "l=3", "k='a b'") == ["2", "", "a b"]
    assert [c.name for c in cols.json_columns("j", '{"a": 1, "b": []}')] == ["j.a", "j.b"]
    assert cols.json_paths('{"a": {"b": [1]}}') == ["a", "a.b", "a.b.0"]
    assert cols.split_columns("c", "-", "solo") == () and len(cols.kv_columns("c", "a=1 b=2")) == 2
    df = spark.createDataFrame([("1", "x.y|z")], "id string, msg string")
    nested = cols.add_computed(df, (Computed("split", "msg", "l", "|", 0), Computed("split", "l", "ll", ".", 1)))
    assert nested.first()["ll"] == "y"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aB1029 é.", max_size=12), min_size=2, max_size=30))
def test_natural_key_orders_like_runs(spark, cells):
    def key(x):
        parts = re.split(r"(\d+)", x.lower())
        return [(parts[k], int(parts[k + 1]) if k + 1 < len(parts) else -1) for k in range(0, len(parts), 2)]

    df = spark.createDataFrame([(c, k) for k, c in enumerate(cells)], "v string, k int").coalesce(1)
    got = [r["v"] for r in df.orderBy(values.natural_key(F.col("v")), "k").collect()]
    assert [key(x) for x in got] == sorted(map(key, cells))


def test_datetimes(spark):
    cells = ["1705312200", "1705312200000", "2024-01-15T10:30:00Z", "2024-01-15 10:30:00,5", "15/Jan/2024:10:30:00 +0000", "Jan 15 10:30:00", "2024/01/15 10:30:00", "1/15/2024", "15/1/2024", "Jan 15, 2024", "10d", "2024", ""]
    got = one(spark, F.date_format(datetimes.parse(F.col("v"), year=2024), "MM-dd HH:mm"), *cells)
    assert got == ["01-15 09:50"] * 2 + ["01-15 10:30"] * 5 + ["01-15 00:00"] * 3 + [None] * 3
    f = lambda target, cell: one(spark, datetimes.reformat(F.col("v"), target), cell)[0]
    assert f("epoch", "2024-01-15 10:30:00") == "1705314600" and f("epoch_ms", "2024-01-15 10:30:00") == "1705314600000"
    assert f("UTC>US/Eastern %H:%M:%S", "2024-01-15 15:00:00") == "10:00:00" and f("UTC>PST %H:%M", "2024-01-15 15:00:00") == "07:00"
    assert f("%d.%m.%Y at", "2024-01-15 10:30:00") == "15.01.2024 at" and f("epoch", "no") == "no" and f("Nowhere> %H", "2024-01-15 10:00:00") == "10"
    assert f("iso", "2024/01/15 10:30:00") == "2024-01-15T10:30:00"
    now = F.to_timestamp(F.lit("2024-01-15 12:35:00"))
    rel = lambda cell: one(spark, datetimes.reformat(F.col("v"), "relative", now=now), cell)[0]
    assert [rel(x) for x in ("2024-01-15 12:34:30", "2024-01-15 12:00:00", "2024-01-15 10:00:00", "2024-01-10 12:35:00", "2022-01-01", "2025-01-01")] == ["30s ago", "35m ago", "2h35m ago", "5d ago", "2y ago", "in the future"]
    assert datetimes.format_hint(["2024/01/15 10:30:00"] * 3) == "%Y/%m/%d %H:%M:%S" and datetimes.format_hint(["1705312200"] * 3) == "epoch"


def names(df):
    return [r["name"] for r in df.collect()]


def test_filters(people):
    assert names(rows.filter_rows(people, (Filter("nyc", "city"), Filter("^a")))) == ["Ann"]
    assert names(rows.filter_rows(people, (Filter("nyc", None, True),))) == ["Bob", "Dan", "Eve"]
    assert names(rows.filter_rows(people, (rows.equals("age", "5"),))) == ["Bob"]
    with pytest.raises(SpecError):
        rows.filter_rows(people, (Filter("x", "none"),))
    assert rows.filter_rows(people, (Filter("x", "none", True),), strict=True).count() == 0
    shown = [rows.filter_rows(people, (Filter("nyc", "city"),))]
    assert sorted(names(rows.excluded_rows(people, shown))) == ["Bob", "Dan", "Eve"]


def test_pivot_and_dedup(people):
    got = rows.pivot(people, ["city"]).orderBy("_ord").collect()
    assert [(r["count"], r["city"], r["name"]) for r in got] == [(2, "NYC", "Cy"), (2, "SF", "Eve"), (1, "LA", "Dan")]
    assert sorted(names(rows.first_per_key(people, ["city"]))) == ["Ann", "Bob", "Dan"]
    assert rows.first_per_key(people, ["none"]).count() == 5


def test_sorts(people):
    assert names(rows.sort_rows(people, Sort("age"), "numeric")) == ["Bob", "Ann", "Cy", "Eve", "Dan"]
    assert names(rows.sort_rows(people, Sort("age", True), "numeric")) == ["Cy", "Ann", "Bob", "Eve", "Dan"]
    assert names(rows.sort_rows(people, Sort("age"), "numeric", strict=True)) == ["Dan", "Cy", "Ann", "Bob", "Eve"]
    assert names(rows.sort_rows(people, Sort("city", True), "string")) == ["Bob", "Eve", "Ann", "Cy", "Dan"]
    assert names(rows.sort_rows(people, Sort("none"), "string")) == [p[0] for p in PEOPLE]
    assert rows.row_at(200, "50%") == 100 and rows.row_at(10, "99") == 9


def test_one_file_is_sorted_by_many_tasks(spark):
    lines = spark.range(30_000, numPartitions=7).select((29_999 - F.col("id")).alias("n"), F.concat(F.lit("line "), 29_999 - F.col("id")).alias("value"))
    tracker, group = spark.sparkContext.statusTracker(), "one file"
    spark.sparkContext.setJobGroup(group, group)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(queries_sources, "COPIED", 1000, raising=False)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            folder = queries_sources.one_file(spark, lines, ["a", "b"])
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            spark.sparkContext._jsc.clearJobGroup()
    where = folder.removeprefix("file:")
    files = [f for f in os.listdir(where) if not f.startswith((".", "_"))]
    assert len(files) == 1
    with open(f"{where}/{files[0]}") as f:
        assert f.read().splitlines() == ["a", "b", *[f"line {k}" for k in range(30_000)]]
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    # the stage that sorts and writes has a task for each range, where it had one in all
    assert len([s for s in stages if (i := tracker.getStageInfo(s)) and i.numTasks > 1]) >= 2


@pytest.mark.parametrize("kind", ["numeric", "datetime", "string"])
def test_sort_compares_columns_and_no_expressions(people, kind):
    df = people.withColumn("_SORT0", F.lit("x"))
    out = rows.sort_rows(df, Sort("age"), kind)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    order = next(x for x in plan.splitlines() if "Sort [" in x).lower()
    assert "rlike" not in order and "lower(" not in order and "trim(" not in order
    assert out.columns == df.columns


def test_windows(spark):
    df = spark.createDataFrame([("10:00", 0), ("10:58", 1), ("10:59", 2), ("?", 3)], "t string, _ord long").withColumn("t", F.when(F.col("t") != "?", F.concat(F.lit("2024-01-01 "), "t", F.lit(":00"))).otherwise("?"))
    assert [r["_ord"] for r in rows.time_window(df, TimeWindow(300, False, "t")).orderBy("_ord").collect()] == [1, 2, 3]
    assert rows.time_window(df, TimeWindow(300, False, "t"), keep_unparsed=False).count() == 2
    with pytest.raises(SpecError):
        rows.time_window(df, TimeWindow(300, False, "none"))


def test_stats(spark):
    df = spark.createDataFrame([("25", 0), ("30", 1), ("45", 2), ("N/A", 3), ("", 4)], "v string, _ord long")
    r = cols.column_stats(df, "v").first()
    assert (r["count"], r["distinct"], r["sum"], r["min"], r["max"], r["skipped"]) == (5, 5, 100.0, 25.0, 45.0, 1)
    t = spark.createDataFrame([("2024-01-15", 0), ("2024-03-20", 1), ("20240115", 2), ("x", 3)], "t string, _ord long")
    r = cols.column_stats_time(t, "t").first()
    assert (r["earliest"], r["latest"], r["skipped"]) == ("2024-01-15", "2024-03-20", 1)
    assert cols.format_number(1234567.0) == "1,234,567" and cols.format_number(0.5) == "0.5"
    assert [tuple(r) for r in cols.value_counts(df.union(df.limit(1)), "v", 2).collect()][0] == ("25", 2)


def test_search_and_marks(people):
    got = [(r["_ord"], r["column"]) for r in cols.search(people, "n", ("city",)).orderBy("_ord", "position").collect()]
    assert got == [(0, "name"), (3, "name"), (4, "age")]
    assert cols.next_match(3, 2) == 0 and cols.next_match(3, 0, -1) == 2 and cols.next_match(0, 0) is None
    assert cols.highlight(people.limit(1), [("n", "red")], ["name"]).first()["name"] == 'A<mark class="red">n</mark><mark class="red">n</mark>'
    assert cols.highlight_count(people, "nyc").first()["rows"] == 2


def test_columns():
    n = ["name", "age", "city"]
    assert cols.matching_columns(n, "A") == ["name", "age"] and cols.ordered_columns(n, "city|na") == ["city", "name"]
    assert cols.ordered_columns(n, "zzz") == n and cols.ordered_columns(n, "all") == n and cols.ordered_columns(n, "city", ("age",)) == ["age", "city"]


def test_merge(people):
    left = people.withColumn("_arrival", F.timestamp_seconds(F.col("_ord") * 2))
    right = people.withColumn("_arrival", F.timestamp_seconds(F.col("_ord") * 2 + 1)).withColumnRenamed("age", "other")
    got = rows.merge(left, right, ("l", "r")).orderBy("_arrival", "_ord").collect()
    assert [r["_source"] for r in got[:4]] == ["l", "r", "l", "r"] and got[1]["age"] is None


def test_csv_like_the_csv_module(spark):
    lines = ["a,b,c", '"x, y",2,"he said ""hi"""', ",,", '"",b,', "plain,1"]
    df = text.lines_of(spark, lines)
    got = text.parse(df, Layout(",", ("a", "b", "c"), None)).orderBy("_ord").collect()
    for line, r in zip(lines, got):
        cells = next(csv.reader([line]))
        assert [r["a"], r["b"], r["c"]][: len(cells)] == cells and r["_ok"] == (len(cells) == 3)


def test_open_tables(spark):
    df, layout = text.open_table(text.lines_of(spark, ["name\tage", "Ann\t 30 ", "", *["Cy\t1"] * 4, "Bob\t5\tx"]))
    assert layout.delimiter == "\t" and sorted({tuple(r) for r in df.select("name", "age", "_ok").collect()}) == [("Ann", "30", True), ("Bob", "5", False), ("Cy", "1", True)]
    good, bad = text.split_ok(df)
    assert good.count() == 5 and bad.first()["_raw"] == "Bob\t5\tx"
    df, _ = text.open_table(text.lines_of(spark, ["[", ' {"a": 1, "b": {"c": null}},', ' {"b": true, "a": "x"}', "]"]))
    assert [tuple(r) for r in df.orderBy("_ord").select("a", "b").collect()] == [("1", '{"c":null}'), ("x", "true")]
    df, _ = text.open_table(text.lines_of(spark, ["[", "  {", '    "op": "add",', '    "value": 1', "  },", "  {", '    "op": "del",', '    "value": 2', "  }", "]"]))
    assert [tuple(r) for r in df.orderBy("_ord").select("op", "value").collect()] == [("add", "1"), ("del", "2")]
    df, layout = text.open_table(text.lines_of(spark, [f"Jan  5 10:00:00 host sshd[1]:{' ok' * k}" for k in (1, 4, 9, 2, 7, 3)]), detect_logs=True)
    assert layout.names == ("timestamp", "host", "process", "pid", "message") and df.first()["pid"] == "1"
    preambled = text.lines_of(spark, ["hello", '{"a": 1}', "x", '{"a": 2, "b": 3}', '{"a": 4}'])
    assert text.first_object(preambled) == (1, '{"a": 1}') and text.first_object(preambled.limit(1)) is None
    for given in (None, "json"):
        df, layout = text.open_table(preambled, given)
        assert layout.names == ("a",) and [r["a"] for r in df.filter("_ok").orderBy("_ord").collect()] == ["1", "2", "4"]
        assert [r["_raw"] for r in df.filter("not _ok").orderBy("_ord").collect()] == ["hello", "x"]
    late = text.lines_of(spark, [*["a plain line"] * 40, '{"k": 1}', '{"k": 2}'])
    assert [r["k"] for r in text.open_table(late, "json")[0].filter("_ok").orderBy("_ord").collect()] == ["1", "2"]
    assert text.open_table(late)[1].delimiter != "json"
    assert infer_layout(["x"], "raw").names == ("log",)


def test_merged_files(spark, tmp_path):
    for k, n in (("b.csv", 40), ("a.csv", 3)):
        (tmp_path / k).write_text("name,age\n" + "".join(f"{k}{j},{j}\n" for j in range(n)))
    df, _ = text.open_merged(spark, [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")])
    got = df.orderBy("_ord").collect()
    assert len(got) == 43 and [r["_source"] for r in got] == ["b.csv"] * 40 + ["a.csv"] * 3 and got[0]["name"] == "b.csv0"
    with pytest.raises(PermissionError):
        text.read_command(spark, "echo x")
    assert text.read_command(spark, "echo x", allow=True).first()["_raw"] == "x"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("Ann", 'a "b", c'), ("B|b", "<x> & y")], "name string, note string").coalesce(1)
    assert list(csv.reader(io.StringIO(sinks.to_text(df, "csv")))) == [["name", "note"], ["Ann", 'a "b", c'], ["B|b", "<x> & y"]]
    assert sinks.to_text(df, "csv").startswith("name,note\r\n") and sinks.to_text(df, "raw") == 'Ann\ta "b", c\nB|b\t<x> & y\n'
    assert sinks.json_rows(sinks.to_text(df, "json"))[0] == {"name": "Ann", "note": 'a "b", c'}
    assert sinks.to_text(df, "markdown").splitlines()[0] == "| name | note     |" and "B\\|b" in sinks.to_text(df, "markdown")
    assert "<td>&lt;x&gt; &amp; y</td>" in sinks.to_text(df, "html")
    assert [sinks.format_of(x) for x in ("a.jsonl", "a.md", "a.log", "a", "a.TSV")] == ["json", "markdown", "raw", "csv", "tsv"]
    sinks.write_file(df, str(tmp_path / "o.html"))
    sinks.write_folder(df, str(tmp_path / "o"), "csv")
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "o")).count() == 2


def run_cli(spark, tmp_path, content, *args):
    (tmp_path / "in.txt").write_text(content)
    out = io.StringIO()
    assert cli.main([str(tmp_path / "in.txt"), *args], spark, out) == 0
    return out.getvalue().replace("\r\n", "\n")


CSV = "name,age,city\nAnn,30,NYC\nBob,5,SF\nCy,100,NYC\n"


@pytest.mark.parametrize(
    ("args", "expected"),
    [
        ((), CSV), (("-f", "city=nyc"), "name,age,city\nAnn,30,NYC\nCy,100,NYC\n"), (("-x", "city=nyc"), "name,age,city\nBob,5,SF\n"), (("-f", "any=5"), "name,age,city\nBob,5,SF\n"),
        (("-s", "age=desc", "-c", "na|age"), "name,age\nCy,100\nAnn,30\nBob,5\n"), (("-u", "city"), "name,age,city\nAnn,30,NYC\nBob,5,SF\n"), (("-o", "tsv"), CSV.replace(",", "\t")), (("--raw",), CSV),
    ],
)
def test_command_line(spark, tmp_path, args, expected):
    got = run_cli(spark, tmp_path, CSV, *args)
    assert got == expected if "-s" in args or "--raw" in args else sorted(got.splitlines()) == sorted(expected.splitlines())


def test_command_line_times(spark, tmp_path):
    got = run_cli(spark, tmp_path, "ts,v\n2024-01-15 10:00:00,b\n2024-01-15 09:00:00,a\n", "-s", "ts=asc", "-F", "ts -> epoch")
    assert got == "ts,v\n1705309200,a\n1705312800,b\n"
    for bad in (["-s", "x=up"], ["-f", "x"], ["--tui"]):
        with pytest.raises(SystemExit):
            cli.parse_args(bad)


def test_build_reports_what_is_missing(people):
    spec = QuerySpec(filters=(Filter("x", "none"),), sort=Sort("gone"), pivot=("city", "lost"), formats=(("t", "iso"),))
    df, skipped = build(spec, people)
    assert df.columns[:2] == ["count", "city"] and skipped == ["filter none", "pivot lost", "sort gone", "format t"]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    layout = Layout(",", ("name", "age", "city"), None)
    good, _ = live.table(live.follow(spark, str(tmp_path / "in")), layout, "name,age,city")
    q = live.start_pivot(good, ["city"], "cities", str(tmp_path / "c1"))
    a = live.appended(good, QuerySpec(filters=(Filter("sf", "city"),)), "sf_only", str(tmp_path / "c2"))
    seen = []
    r = live.recomputed(good, QuerySpec(sort=Sort("age"), types=(("age", "numeric"),)), str(tmp_path / "kept"), str(tmp_path / "c3"), lambda df, n: seen.append(df.select("name").collect()), "100 milliseconds")
    for k, body in enumerate((CSV, "name,age,city\nDan,7,SF\nbroken\nEve,1,NYC\n")):
        (tmp_path / "in" / f"{k}.csv").write_text(body)
        for x in (q, a, r):
            x.processAllAvailable()
    for x in (q, a, r):
        x.stop()
    assert {(x["city"], x["count"]) for x in spark.table("cities").collect()} == {("NYC", 3), ("SF", 2)}
    assert {x["name"] for x in spark.table("sf_only").collect()} == {"Bob", "Dan"}
    assert [x["name"] for x in seen[-1]] == ["Eve", "Bob", "Dan", "Ann", "Cy"]
    assert live.follow_interval(300) == 5 and live.follow_interval(3) == 1 and live.needs_recompute(QuerySpec(sort=Sort("a")))


def test_command_source(spark):
    spark.dataSource.register(live.CommandSource)
    assert spark.read.format("command").option("command", "printf 'a\\nb\\n'").option("allow", "true").load().count() == 2


def test_arrival_text(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 1, 1, 10, 0, 0, 5000),)], "t timestamp")
    assert df.select(datetimes.arrival_text(F.col("t"))).first()[0].endswith(".005Z")


def test_long_quoted_cells(spark):
    long = 'x "" y, ' * 125_000
    df = spark.createDataFrame([(f'1,"{long}",end',), ('2,"a"",""b",end',), ("3,plain,",)], "_raw string").withColumn("_ord", F.monotonically_increasing_id())
    got = text.parse(df, Layout(",", ("k", "v", "w"), None)).orderBy("_ord").collect()
    assert [(r["k"], r["v"], r["w"], r["_ok"]) for r in got] == [("1", long.replace('""', '"').strip(), "end", True), ("2", 'a","b', "end", True), ("3", "plain", "", True)]


def test_folders_in_file_order(spark, tmp_path):
    for name, rows in (("b 2.csv", ["name,n", "x,1", "name,n"]), ("a.csv", ["name,n", *[f"y{k},{k}" for k in range(300)]]), ("c.csv", ["name,n", "z,3"])):
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    df, layout = text.open_files(spark, [str(tmp_path)])
    got = df.orderBy("_ord").collect()
    # each file's first line is its header; the line that repeats it further down is data
    assert [r["name"] for r in got] == [*[f"y{k}" for k in range(300)], "x", "name", "z"] and layout.delimiter == ","
    assert {r["_source"] for r in got} == {"a.csv", "b 2.csv", "c.csv"}
    df, _ = text.open_merged(spark, [str(tmp_path / "c.csv"), str(tmp_path / "b 2.csv")])
    assert [r["name"] for r in df.orderBy("_ord").collect()] == ["z", "x", "name"]


def test_layout_that_does_not_fit_is_changed(spark):
    lines = ["a,b,c", "1,2,3", *[f"{k}|x{k}|y|z" for k in range(40)]]
    rows = [(k, x) for k, x in enumerate(lines)]
    layout, found = text.relayout(Layout(",", ("a", "b", "c"), 0), rows[:20], rows)
    assert layout.delimiter == "|" and found[0][1].endswith("|y|z")
    assert text.relayout(Layout(",", ("a", "b", "c"), 0), rows[:2], rows[:4])[0].delimiter == ","


def test_inferred_shapes():
    from sluice.plans import logformats

    behind = [f"something {'odd ' * (k % 3)}happened 2024-01-0{k} 10:00:0{k} 10.0.0.{k}" for k in range(1, 6)]
    fmt = logformats.infer_pattern(behind)
    assert fmt.columns == ("message", "timestamp", "ip")
    shaped = [f"a{k}-b{k} E {'w ' * k}end" for k in range(1, 6)]
    assert logformats.infer_pattern(shaped).columns == ("field_1", "severity", "message")
    tagged = [f"[2024-01-0{k} 10:00] [ERROR] [main] [x] msg {'w ' * k}" for k in range(1, 6)]
    assert logformats.infer_pattern(tagged).columns == ("timestamp", "level", "thread", "tag", "message")
    assert logformats.choose(tagged).name == "inferred" and logformats.choose(["1.2.3.4 - - [01/Jan/2024:10:00:00 +0000] \"GET /x HTTP/1.1\" 404 0"] * 4).name == "Apache/nginx Common"


def test_command_line_files_and_sessions(spark, tmp_path):
    from sluice.plans.spec import Store

    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("x,y\n5,6\n")
    Store(str(tmp_path / "s")).save("mine", QuerySpec(filters=(Filter("[15]", "x"),)))

    def run(*args):
        out = io.StringIO()
        assert cli.main([str(tmp_path / x) if x.endswith(".csv") else x for x in args], spark, out) == 0
        return out.getvalue().replace("\r\n", "\n")

    assert run("a.csv", "b.csv") == "x,y\n1,2\n3,4\nx,y\n5,6\n"
    assert run("-m", "a.csv", "b.csv") == "x,y\n1,2\n3,4\n5,6\n"
    assert run("a.csv", "-S", "mine", "--sessions", str(tmp_path / "s")) == "x,y\n1,2\n"
    assert run("a.csv", "--tail", "--last", "1") == "x,y\n3,4\n"
    assert cli.main([str(tmp_path / "missing.csv")], spark, io.StringIO()) == 1
    for bad in (["-m", "a.csv"], ["-S", "none", "--sessions", str(tmp_path / "s"), "a.csv"]):
        with pytest.raises(SystemExit):
            cli.parse_args(bad)


def test_group_names():
    assert regexes.name_groups(r"(\d+) [(]x[)] \((?:a|(b))\) (?P<c>.)", ["n", "m"]) == r"(?P<n>\d+) [(]x[)] \((?:a|(?P<m>b))\) (?P<c>.)"
    assert regexes.unnamed_groups(r"(a)[^](](?=b)(c)(?P<d>e)") == 2 and regexes.name_groups("(a)(b)", ["x"]) == "(?P<x>a)(b)"


def test_views_and_history(people):
    from sluice.plans.build import show
    from sluice.plans.spec import History

    start = QuerySpec(filters=(Filter("nyc", "city"),), sources=("a",))
    h = History(start, start)
    view = QuerySpec(search="a", tail=True, marks=(("m", 0), ("z", 99)))
    assert h.apply(view).sources == ("a",) and h.undo() == start and h.undo() == start
    assert h.fresh() == start
    seen = show(view, people)
    assert seen.marks == {"m": 0} and "mark z" in seen.skipped and seen.matches.count() > 0
    assert seen.table.count() == people.count()


def test_pipes(spark, tmp_path):
    import os

    read, write = os.pipe()
    feeder = live.Feeder(str(tmp_path / "in"), idle=0.01, hold=0.05)
    thread = feeder.start(os.fdopen(read, "rb"))
    for part in (b"name,n\nx,1\ny", b",2\nbroken\n", b"z,3"):
        os.write(write, part)
        __import__("time").sleep(0.1)
    os.close(write)
    thread.join(10)
    assert feeder.files >= 2
    skips = live.Skips(keep=1)
    lines = live.follow(spark, str(tmp_path / "in"))
    q = live.accounted(lines, Layout(",", ("name", "n"), None), "name,n", str(tmp_path / "out"), str(tmp_path / "c"), skips, availableNow=True)
    q.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out/*").collect()
    assert sorted((r["name"], r["n"]) for r in got) == [("x", "1"), ("y", "2"), ("z", "3")]
    assert (skips.rows, skips.skipped, skips.samples) == (4, 1, ["broken"]) and live.pressure(q) >= 0
    with pytest.raises(PermissionError):
        live.feed_command("echo x", str(tmp_path / "d"))
    process, thread = live.feed_command("printf 'a\\nb\\n'", str(tmp_path / "d"), allow=True)
    thread.join(10)
    assert process.wait() == 0 and (tmp_path / "d" / "part-000000000.txt").read_text() == "a\nb\n"


def test_live_pivot_with_last_cells(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x,1\ny,2\nx,3\n")
    good, _ = live.table(live.follow(spark, str(tmp_path / "in")), Layout(",", ("k", "v"), None))
    live.start_pivot(good.withColumn("_at", F.col("v").cast("int")).drop("_place", "_arrival", "_source"), ["k"], "with_last", str(tmp_path / "c"), "_at", availableNow=True).awaitTermination(60)
    assert [tuple(r) for r in spark.table("with_last").collect()] == [(2, "x", "3"), (1, "y", "2")]


def test_folder_of_json_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text('[\n  {\n    "k": 1,\n    "v": "x"\n  },\n  {\n    "k": 2,\n    "v": "y"\n  }\n]\n')
    (tmp_path / "b.json").write_text('{\n  "k": 3,\n  "v": "z"\n}\n')
    df, layout = text.open_files(spark, [str(tmp_path)])
    assert layout.names == ("k", "v") and [(r["k"], r["v"], r["_source"]) for r in df.orderBy("_ord").collect()] == [("1", "x", "a.json"), ("2", "y", "a.json"), ("3", "z", "b.json")]


def test_recomputed_over_merged_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "MERGE", 2)
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"{k}.txt").write_text(f"k{k % 3},{k}\n")
    good, _ = live.table(live.follow(spark, str(tmp_path / "in"), 1), Layout(",", ("k", "v"), None))
    seen = []
    live.recomputed(good, QuerySpec(sort=Sort("v"), columns="v"), str(tmp_path / "kept"), str(tmp_path / "c"), lambda df, n: seen.append([r["v"] for r in df.collect()]), availableNow=True).awaitTermination(90)
    assert seen[-1] == ["0", "1", "2", "3", "4"] and [len(x) for x in seen] == [1, 2, 3, 4, 5]
