"""Queries as text and JSON, durations, and the store."""

import pytest

from sluice.plans.spec import Computed, Filter, QuerySpec, Sort, SpecError, Store, TimeWindow, find_column, format_duration, parse_duration, parse_filter, parse_format, parse_sort, parse_window


@pytest.mark.parametrize(("text", "seconds"), [("5", 300), ("0.5", 30), ("30s", 30), ("5m", 300), ("2h", 7200), ("1d", 86400), ("1h30m", 5400), ("1d2h30m15s", 95415), ("", None), ("abc", None), ("0", None), ("-5m", None)])
def test_durations(text, seconds):
    assert parse_duration(text) == seconds


def test_windows():
    assert parse_window("off") is None
    assert parse_window("ts 5m+") == TimeWindow(300, True, "ts")
    assert parse_window("1h") == TimeWindow(3600)
    with pytest.raises(SpecError):
        parse_window("ts soon")
    assert format_duration(93780) == "1d2h3m" and format_duration(42) == "42s"


def test_filters_and_sorts():
    assert parse_filter("city=a=b") == Filter("a=b", "city")
    assert parse_filter("any=x", True) == Filter("x", None, True)
    for bad in ("x", "=y", "a=("):
        with pytest.raises(SpecError):
            parse_filter(bad)
    assert parse_sort("age=desc") == Sort("age", True)
    with pytest.raises(SpecError):
        parse_sort("age=up")
    assert parse_format("ts -> epoch") == ("ts", "epoch")


def test_json_round_trip():
    spec = QuerySpec(",", (Computed("split", "a", "a-1", "-", 0),), (Filter("x", "a"),), TimeWindow(60, True, "t"), ("a",), ("b",), Sort("b", True), (("t", "iso"),), "a|b", ("c",), ("d",), ("e",), (("a", "numeric"),), (("x", "red"),), "find", True, ("f.csv",), (("m", 3),))
    assert QuerySpec.from_json(spec.to_json()) == spec
    assert QuerySpec.from_json("{}") == QuerySpec()


def test_edits():
    s = QuerySpec().toggle_key("city")
    assert s.pivot == ("city",) and s.sort == Sort("count", True)
    assert s.with_filter(Filter("x", "city")).pivot == ()
    assert s.toggle_key("city").sort is None
    a = QuerySpec().cycle_sort("x")
    assert a.sort == Sort("x") and a.cycle_sort("x").sort == Sort("x", True) and a.cycle_sort("x").cycle_sort("x").sort is None
    kept = QuerySpec(filters=(Filter("x"),), sort=Sort("a"), search="q").cleared()
    assert kept.filters and not kept.sort and not kept.search
    assert QuerySpec(filters=(Filter("x"),)).with_delimiter("|") == QuerySpec(delimiter="|")
    assert QuerySpec(search="q").search_as_filter().filters == (Filter("q"),)
    two = QuerySpec(computed=(Computed("split", "a", "a-1", "-", 0), Computed("split", "a", "a-2", "-", 1)))
    assert two.without_last_computed().computed == ()
    assert QuerySpec().moved(["a", "b", "c"], "a", 1).order == ("b", "a", "c")
    assert QuerySpec(pinned=("a",)).moved(["a", "b"], "a", 1).order == ()


def test_store(tmp_path):
    store = Store(str(tmp_path / "views"))
    assert store.names() == []
    store.save("one", QuerySpec(sources=("/data/x.log",)))
    store.save("two", QuerySpec(sort=Sort("a")))
    (tmp_path / "views" / "bad.json").write_text("{")
    assert set(store.names()) == {"one", "two"} and store.broken == ["bad.json"]
    assert store.load("two").sort == Sort("a")
    assert store.of_source("/other/x.log") == ["one"]
    store.rename("two", "three")
    store.delete("one")
    assert store.names() == ["three"]


def test_column_names():
    assert find_column("AGE", ["age", "city"]) == "age" and find_column('"age"', ["age"]) == "age"
    with pytest.raises(SpecError, match="perhaps city"):
        find_column("citi", ["age", "city"])
