"""What is decided before a table is read: inference, patterns, times, and the query as data, on fixed samples."""

import os
import tempfile

import pytest

from sluice.functions import datetimes, regexes
from sluice.operators import columns as cols
from sluice.operators import rows
from sluice.plans import infer, logformats
from sluice.plans.build import build
from sluice.plans.spec import Computed, Filter, History, QuerySpec, Sort, SpecError, Store, TimeWindow, find_column, format_duration, parse_duration, parse_filter, parse_format, parse_sort, parse_window
from sluice.queries_plans import read

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def nations(spark, d) -> list[tuple[str, str, str]]:
    return [(str(r[0]), r[1], str(r[2])) for r in read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]


# inference from sample lines: each function gives (case, found) pairs


def infer_json(spark, d):
    objects = [f'{{"key": {k}, "name": "{n}"}}' for k, n, _ in nations(spark, d)]
    return [("lines", infer.is_json(objects)), ("list", infer.is_json(["[", *[f"{x}," for x in objects], "]"])), ("mixed", infer.is_json([*objects, "text"])), ("numbers", infer.is_json(["1", "2"])), ("start", infer.is_json_start(["", "  [", "{"]))]


def infer_delimiters(spark, d):
    data = [("key", "name", "region"), *nations(spark, d)[:14]]
    cases = {"comma": ",", "tab": "\t", "bar": "|", "semicolon": ";"}
    return [(name, infer.infer_delimiter([sep.join(r) for r in data])) for name, sep in cases.items()]


def infer_agreement(spark, d):
    """A delimiter that fewer than 0.8 of the lines agree on scores nothing."""
    good = [",".join(r) for r in nations(spark, d)[:10]]
    return [("agree", infer.infer_delimiter(good)), ("one off", infer.infer_delimiter([*good, "a,b"])), ("half", infer.infer_delimiter([x if k % 2 else x.replace(",", "", 1) for k, x in enumerate(good)]))]


def infer_spaces(spark, d):
    """Single blanks with a longer last field, and a short line in front."""
    lines = [f"host{k} user{k} a b run" for k in range(9)]
    longer = [f"host{k} user{k} a b run{' again' * (k % 2)}" for k in range(9)]
    return [("plain", infer.infer_delimiter(lines)), ("preamble", infer.infer_delimiter(["total 12", *lines])), ("no fields", infer.infer_delimiter(["total", *lines])), ("overflow", infer.infer_delimiter(longer))]


def infer_wide_gaps(spark, d):
    lines = [f"{k:<6}{n:<20}{r} of it" for k, n, r in nations(spark, d)[:12]]
    return [("two blanks", infer.infer_delimiter(["key   name                region no", *lines]))]


def infer_places(spark, d):
    lines = ["key   name            region", *[f"{k:<6}{n:<16}{r}" for k, n, r in nations(spark, d)[:12]]]
    return [("offsets", ",".join(map(str, infer.column_offsets(lines)))), ("cells", "/".join(infer.by_offsets(lines[1], infer.column_offsets(lines))))]


def infer_raw(spark, d):
    return [("words", infer.infer_delimiter([f"line{k}" for k in range(9)])), ("nothing", infer.infer_delimiter(["", " "])), ("tie", infer.infer_delimiter(["a,b|c", "d,e|f", "g,h|i"]))]


def infer_cap(spark, d):
    lines = [f"host{k} user{k} pid{k} run{' again' * (k == 3)}" for k in range(9)]
    return [("longer", infer.most_fields(lines, " ")), ("even", infer.most_fields(lines[:3], " ")), ("comma", infer.most_fields(["a,b", "a"], ","))]


def infer_strategy(spark, d):
    lines = ["name      ready   age", *[f"pod-{k}     1/1     {k}d" for k in range(8)]]
    wordy = ["name      is ready  age", *[f"pod-{k}     1/1       {k}d" for k in range(8)]]
    return [(name, str(infer.aligned_strategy(x, " "))) for name, x in (("even", lines), ("header of more words", wordy))]


def infer_header(spark, d):
    data = [",".join(r) for r in nations(spark, d)[:10]]
    return [("first", infer.header_index(["k,n,r", *data], ",")), ("third", infer.header_index(["made by hand", "on monday", "k,n,r", *data], ",")), ("one less", infer.header_index(["a b", *["1 2 3"] * 9], " "))]


def infer_preamble(spark, d):
    long = ["name" + " " * 40 + "age", *[f"{n:<44}{k}" for k, n, _ in nations(spark, d)[:6]]]
    return [("two", infer.preamble_end(["short", "also short", *long])), ("none", infer.preamble_end(long))]


def infer_sample(spark, d):
    return [("parts", ",".join(infer.sample_of([k for k, _, _ in nations(spark, d)]))), ("few", ",".join(infer.sample_of(["a", "b"])))]


def infer_typed(spark, d):
    return [(x, repr(infer.parse_delimiter(x))) for x in ("\\t", "tab", "space", "space+", "raw", ",")] + [("pattern", str(infer.is_pattern(r"(\d+) (.*)"))), ("literal", str(infer.is_pattern("||")))]


def infer_names(spark, d):
    return [("repeated", ",".join(infer.unique_names(["a", "b", "a", "a", "a_2"])))]


def infer_kinds(spark, d):
    """Types of columns by name, by cells and by the user's word."""
    days = [f"2024-01-{k:02d} 10:00:00" for k in range(1, 13)]
    cases = {
        "number": ("x", [k for k, _, _ in nations(spark, d)], None), "text": ("x", [n for _, n, _ in nations(spark, d)], None), "time": ("x", days, None), "epoch": ("x", [str(1_700_000_000 + k) for k in range(9)], None),
        "named": ("created_at", ["a", "b", "c"], None), "few": ("x", ["1", "2"], None), "told": ("x", days, "string"), "auto": ("x", days, "auto"), "mostly": ("x", [*["1"] * 8, "n/a", "-"], None),
    }
    return [(name, infer.column_type(*x)[0]) for name, x in cases.items()]


def infer_hints(spark, d):
    cases = {"iso": "2024-01-05T10:00:00", "comma": "2024-01-05 10:00:00,123", "log": "05/Jan/2024:10:00:00 +0000", "epoch": "1704448800", "slashes": "2024/01/05 10:00:00", "short": "Jan  5 10:00:00", "text": "monday"}
    return [(name, str(datetimes.format_hint([v] * 5))) for name, v in cases.items()]


def infer_splits(spark, d):
    return [
        ("bars", str(infer.splittable([f"a|{k}" for k in range(9)]))), ("words", str(infer.splittable(["a", "b", "c=d"]))), ("json", ",".join(infer.cell_suggestions('{"a": 1}'))), ("pairs", ",".join(infer.cell_suggestions("a=1;b=2;c=3"))), ("dots", ",".join(infer.cell_suggestions("1.2.3:4"))),
    ]


def log_detection(spark, d):
    events = read(spark, d, "events").orderBy("event_id").limit(12).collect()
    common = [f'10.0.0.1 - u{r["user_id"]} [01/Jan/2024:00:00:00 +0000] "GET /{r["event_type"]} HTTP/1.1" 200 1' for r in events]
    python = [f"2024-01-15 14:23:01,123 - app.{r['event_type']} - INFO - user {r['user_id']}" for r in events]
    mine = (logformats.LogFormat("mine", r"(?P<a>\S+) - (?P<b>.*)", 100, True),)
    return [
        ("common", logformats.detect(common).name), ("combined", logformats.detect([x + ' "-" "a"' for x in common]).name), ("python", logformats.detect(python).name), ("custom", logformats.detect(common, mine).name),
        ("half", str(logformats.detect([*common[:6], *["x"] * 6]))), ("best", ",".join(f.name for _, f in logformats.candidates(common))),
    ]


def log_inference(spark, d):
    events = read(spark, d, "events").orderBy("event_id").limit(12).collect()
    cases = {
        "leading": [f"2024-01-01 10:00:{k:02d} INFO user {r['user_id']} {'did ' * (k % 3)}{r['event_type']}" for k, r in enumerate(events)],
        "tabs": [f"10.0.0.{k}\t{200 + k}\thello {r['event_type']}" for k, r in enumerate(events)],
        "bars": [f"2024-01-01 | E | m{k} | some {'more ' * (k % 3)}words" for k, r in enumerate(events)],
        "dashes": [f"2024-01-01 10:00:00 - app.{r['event_type']} - INFO - it went {'very ' * (k % 3)}well" for k, r in enumerate(events)],
        "behind": [f"it went {'very ' * (k % 3)}well 2024-01-01 10:00:{k:02d} 10.0.0.{k}" for k, r in enumerate(events)],
        "brackets": [f"[2024-01-01 10:00] [ERROR] [main] m {'x ' * (k % 3)}end" for k, r in enumerate(events)],
        "shapes": [f"a{k}-b{k} E {'w ' * (k % 3)}end" for k, r in enumerate(events)],
        "quoted": [f'"GET /{k}" 200 12ms 550e8400-e29b-41d4-a716-4466554400{k:02d} {"w " * (k % 3)}end' for k, r in enumerate(events)],
    }
    return [(name, ",".join(f.columns) if (f := logformats.infer_pattern(x)) else "none") for name, x in cases.items()] + [("nothing", str(logformats.infer_pattern(["a", "b b", "c c c"])))]


def log_tokens(spark, d):
    return [(t, str(logformats.classify(t))) for t in ("2024-01-01", "10:00:00", "[x y]", '"q"', "<34>", "10.0.0.1", "12#3", "GET", "/a/b", "12ms", "k=v", "WARN", "a.b.c", "E", "404", "12345", "hello")] + [("split", "/".join(logformats.tokens('a [b c] "d e" f', " "))), ("shape", logformats.shape("ab12-c.3"))]


def log_custom(spark, d):
    path = os.path.join(tempfile.mkdtemp(), "formats.json")
    for pattern in (r"(?P<a>\d+)~(?P<b>.*)", r"(?P<k>\d+)~(?P<v>.*)"):
        logformats.save_custom(path, logformats.LogFormat("mine", pattern))
    with open(path + ".bad", "w") as f:
        f.write('[{"name": "x", "pattern": "("}, {"name": "y", "pattern": "z"}, {"name": "z", "pattern": "(?P<q>.)"}]')
    return [("saved", ",".join(",".join(f.columns) for f in logformats.load_custom(path))), ("bad", ",".join(f"{f.name}{f.priority}" for f in logformats.load_custom(path + ".bad"))), ("none", str(len(logformats.load_custom(path + ".none"))))]


def spec_texts(spark, d):
    def error(f, x):
        try:
            return str(f(x))
        except SpecError:
            return "error"

    return [
        ("filter", str(parse_filter("a=b=c") == Filter("b=c", "a"))), ("any", str(parse_filter("any=x", True) == Filter("x", None, True))), ("bad filter", error(parse_filter, "x")), ("sort", str(parse_sort("a=b=desc") == Sort("a=b", True))), ("bad sort", error(parse_sort, "a=up")),
        ("window", str(parse_window("ts 1h30m+") == TimeWindow(5400.0, True, "ts"))), ("bad window", error(parse_window, "ts x")), ("clear", str(parse_window("off"))), ("format", str(parse_format(" ts -> epoch "))), ("column", find_column('"NAME"', ["name", "n"])), ("no column", error(lambda x: find_column(x, ["name"]), "nam")),
    ]


def spec_durations(spark, d):
    return [(x, str(parse_duration(x))) for x in ("1d2h3m4s", "90", "1.5h", "0m", "x", "30s")] + [(f"{s} s", format_duration(s)) for s in (93784, 59, 3600, 0)]


def spec_places(spark, d):
    return [(f"{n} of {t}", str(rows.row_at(t, n))) for t, n in ((25, "1"), (25, "99"), (25, "50%"), (25, "100%"), (25, "0%"))] + [(f"match {k}", str(cols.next_match(3, k, s))) for k, s in ((0, 1), (2, 1), (0, -1))] + [("no match", str(cols.next_match(0, 0)))]


def spec_history(spark, d):
    start = QuerySpec(filters=(Filter("x"),), sources=("a",))
    h = History(start, start)
    h.apply(QuerySpec(sort=Sort("b")))
    applied = h.spec
    return [("sources", ",".join(applied.sources)), ("sort", applied.sort.column), ("undone", str(h.undo() == start)), ("again", str(h.undo() == start)), ("fresh", str(h.fresh() == start))]


def spec_store(spark, d):
    store = Store(tempfile.mkdtemp())
    store.save("one", QuerySpec(sources=("/x/log.txt",)))
    store.save("two", QuerySpec(sources=("/y/log.txt",)))
    found = ",".join(store.of_source("/y/log.txt"))
    store.rename("one", "three")
    with open(f"{store.folder}/bad.json", "w") as f:
        f.write("{")
    return [("match", found), ("names", ",".join(sorted(store.names()))), ("broken", ",".join(store.broken)), ("loaded", store.load("three").sources[0])]


def spec_edits(spark, d):
    s = QuerySpec(filters=(Filter("x", "a"),), search="q", pinned=("p",))
    pivot = s.toggle_key("a").toggle_key("b")
    split = QuerySpec(computed=(*cols.split_columns("a", ",", "1,2"), *cols.split_columns("b", ";", "1;2;3")))
    return [
        ("search", str(s.search_as_filter().filters[-1] == Filter("q"))), ("none", str(len(s.without_filters().filters))), ("pivot", ",".join(pivot.pivot)), ("pivot sort", pivot.sort.column), ("unpivot", str(pivot.toggle_key("a").toggle_key("b").sort)), ("key filter", ",".join(pivot.with_filter(Filter("1", "a")).pivot)),
        ("cycle", "/".join(str(x.sort and x.sort.descending) for x in (s.cycle_sort("c"), s.cycle_sort("c").cycle_sort("c"), s.cycle_sort("c").cycle_sort("c").cycle_sort("c")))), ("moved", ",".join(s.moved(["a", "b", "c"], "a", 1).order)), ("pinned", ",".join(s.moved(["p", "b"], "p", 1).order)), ("cleared", str(s.cleared().search)),
        ("delimiter", str(len(s.with_delimiter("|").filters))), ("undo split", ",".join(c.name for c in split.without_last_computed().computed)),
    ]


def group_names(spark, d):
    return [("named", regexes.name_groups(r"(\d+)[(]\((?:x)(y)", ["n", "m"])), ("unnamed", str(regexes.unnamed_groups(r"(a)(?P<b>c)(d)"))), ("literal", regexes.literal("a.b(c)")), ("substitution", str(regexes.parse_substitution("s/a\\/b/c/gi") == regexes.Substitution("a/b", "c", True, True)))]


def json_cells(spark, d):
    cell = '{"a": {"b": [1, {"c": 2}]}, "d": null}'
    return [("paths", ",".join(cols.json_paths(cell))), ("columns", ",".join(c.name for c in cols.json_columns("x", cell))), ("pairs", ",".join(c.name for c in cols.kv_columns("x", "k=1 l=2 k=3"))), ("one pair", str(cols.kv_columns("x", "k=1"))), ("renamed", ",".join(c.name for c in cols.rename(cols.json_columns("x", cell), {"x.a": "y"})))]


#: What each of the cases is to find.
FOUND = {
    "infer_json": [('lines', 'True'), ('list', 'True'), ('mixed', 'False'), ('numbers', 'False'), ('start', 'True')],
    "infer_delimiters": [('comma', ','), ('tab', '\t'), ('bar', '|'), ('semicolon', ';')],
    "infer_agreement": [('agree', ','), ('one off', ','), ('half', 'raw')],
    "infer_spaces": [('plain', ' '), ('preamble', ' '), ('no fields', 'raw'), ('overflow', ' ')],
    "infer_wide_gaps": [('two blanks', '  ')],
    "infer_places": [('offsets', '0,6,22'), ('cells', '0/NATION_0/0')],
    "infer_raw": [('words', 'raw'), ('nothing', 'raw'), ('tie', ',')],
    "infer_cap": [('longer', '4'), ('even', '0'), ('comma', '0')],
    "infer_strategy": [('even', '(None, 0)'), ('header of more words', '([0, 10, 20], 0)')],
    "infer_header": [('first', '0'), ('third', '2'), ('one less', '0')],
    "infer_preamble": [('two', '2'), ('none', '0')],
    "infer_sample": [('parts', '0,1,2,3,4,10,11,12,13,14,20,21,22,23,24'), ('few', 'a,b')],
    "infer_typed": [('\\t', "'\\t'"), ('tab', "'\\t'"), ('space', "' '"), ('space+', "'  '"), ('raw', "'raw'"), (',', "','"), ('pattern', 'True'), ('literal', 'False')],
    "infer_names": [('repeated', 'a,b,a_2,a_3,a_2_2')],
    "infer_kinds": [('number', 'numeric'), ('text', 'string'), ('time', 'datetime'), ('epoch', 'datetime'), ('named', 'datetime'), ('few', 'string'), ('told', 'string'), ('auto', 'datetime'), ('mostly', 'numeric')],
    "infer_hints": [('iso', 'None'), ('comma', 'None'), ('log', '%d/%b/%Y:%H:%M:%S %z'), ('epoch', 'epoch'), ('slashes', '%Y/%m/%d %H:%M:%S'), ('short', '%b %d %H:%M:%S'), ('text', 'None')],
    "infer_splits": [('bars', 'True'), ('words', 'False'), ('json', 'json,:'), ('pairs', 'kv,;'), ('dots', '.,:')],
    "log_detection": [('common', 'Apache/nginx Common'), ('combined', 'Apache/nginx Combined'), ('python', 'Python Logging Dash'), ('custom', 'mine'), ('half', 'None'), ('best', 'Apache/nginx Common')],
    "log_inference": [('leading', 'timestamp,level,message'), ('tabs', 'ip,status,field_3,message'), ('bars', 'date,severity,message'), ('dashes', 'timestamp,logger,level,message'), ('behind', 'message,timestamp,ip'), ('brackets', 'timestamp,level,thread,message'), ('shapes', 'field_1,severity,message'), ('quoted', 'request,status,duration,uuid,message'), ('nothing', 'None')],
    "log_tokens": [('2024-01-01', 'date'), ('10:00:00', 'time'), ('[x y]', 'bracket'), ('"q"', 'quoted'), ('<34>', 'priority'), ('10.0.0.1', 'ip'), ('12#3', 'pid'), ('GET', 'method'), ('/a/b', 'path'), ('12ms', 'duration'), ('k=v', 'kv'), ('WARN', 'level'), ('a.b.c', 'logger'), ('E', 'severity'), ('404', 'status'), ('12345', 'number'), ('hello', 'None'), ('split', 'a/[b c]/"d e"/f'), ('shape', 'LD-L.D')],
    "log_custom": [('saved', 'k,v'), ('bad', 'z100'), ('none', '0')],
    "spec_texts": [('filter', 'True'), ('any', 'True'), ('bad filter', 'error'), ('sort', 'True'), ('bad sort', 'error'), ('window', 'True'), ('bad window', 'error'), ('clear', 'None'), ('format', "('ts', 'epoch')"), ('column', 'name'), ('no column', 'error')],
    "spec_durations": [('1d2h3m4s', '93784.0'), ('90', '5400.0'), ('1.5h', '5400.0'), ('0m', 'None'), ('x', 'None'), ('30s', '30.0'), ('93784 s', '1d2h3m'), ('59 s', '59s'), ('3600 s', '1h'), ('0 s', '0s')],
    "spec_places": [('1 of 25', '0'), ('99 of 25', '24'), ('50% of 25', '12'), ('100% of 25', '24'), ('0% of 25', '0'), ('match 0', '1'), ('match 2', '0'), ('match 0', '2'), ('no match', 'None')],
    "spec_history": [('sources', 'a'), ('sort', 'b'), ('undone', 'True'), ('again', 'True'), ('fresh', 'True')],
    "spec_store": [('match', 'two,one'), ('names', 'three,two'), ('broken', 'bad.json'), ('loaded', '/x/log.txt')],
    "spec_edits": [('search', 'True'), ('none', '0'), ('pivot', 'a,b'), ('pivot sort', 'count'), ('unpivot', 'None'), ('key filter', 'b'), ('cycle', 'False/True/None'), ('moved', 'b,a,c'), ('pinned', ''), ('cleared', 'None'), ('delimiter', '0'), ('undo split', 'a-1,a-2')],
    "group_names": [('named', '(?P<n>\\d+)[(]\\((?:x)(?P<m>y)'), ('unnamed', '2'), ('literal', 'a\\.b\\(c\\)'), ('substitution', 'True')],
    "json_cells": [('paths', 'a,a.b,a.b.0,a.b.1,a.b.1.c,d'), ('columns', 'x.a,x.d'), ('pairs', 'x.k,x.l'), ('one pair', '()'), ('renamed', 'y,x.d')],
}


CASES = [f for name, f in list(globals().items()) if name in FOUND]


@pytest.mark.parametrize("case", CASES, ids=lambda f: f.__name__)
def test_case(spark, case):
    assert [(k, str(v)) for k, v in case(spark, SF)] == FOUND[case.__name__]


def test_columns_arranged(spark):
    spec = QuerySpec(hidden=("c_acctbal",), pinned=("c_nationkey",), order=("c_name", "c_custkey"))
    df = read(spark, SF, "customer", "c_custkey").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", rows.ORDER)
    assert build(spec, df)[0].columns == ["c_nationkey", "c_name", "c_custkey"]


def test_build_skips(spark):
    spec = QuerySpec(filters=(Filter("x", "none"),), sort=Sort("gone"), pivot=("n_name", "lost"), formats=(("t", "iso"),), computed=(Computed("split", "no", "y", ","),))
    _, skipped = build(spec, read(spark, SF, "nation", "n_nationkey"))
    assert sorted(skipped) == ["computed y", "filter none", "format t", "pivot lost", "sort gone"]
