"""The declarative query: what a view holds, as JSON; durations, filters and sorts as text."""

from __future__ import annotations

import json
import os
import re
import tempfile
from dataclasses import asdict, dataclass, field, replace


class SpecError(ValueError):
    pass


@dataclass(frozen=True)
class Filter:
    """A pattern on a column, or on any column where column is None; exclude negates it."""

    pattern: str
    column: str | None = None
    exclude: bool = False
    ignore_case: bool = True


@dataclass(frozen=True)
class Sort:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class TimeWindow:
    """The last seconds before a ceiling: the largest time, or now if rolling; of a column, or of arrival."""

    seconds: float
    rolling: bool = False
    column: str | None = None


@dataclass(frozen=True)
class Computed:
    """A column made from another: kind is split, regex, json, kv, substitute or time."""

    kind: str
    source: str
    name: str = ""
    argument: str = ""
    index: int = 0
    by: str = ""
    ignore_case: bool = False


@dataclass(frozen=True)
class QuerySpec:
    delimiter: str | None = None
    computed: tuple[Computed, ...] = ()
    filters: tuple[Filter, ...] = ()
    window: TimeWindow | None = None
    unique: tuple[str, ...] = ()
    pivot: tuple[str, ...] = ()
    sort: Sort | None = None
    formats: tuple[tuple[str, str], ...] = ()
    columns: str | None = None
    hidden: tuple[str, ...] = ()
    pinned: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    types: tuple[tuple[str, str], ...] = ()
    highlights: tuple[tuple[str, str], ...] = ()
    search: str | None = None
    tail: bool = False
    sources: tuple[str, ...] = ()
    marks: tuple[tuple[str, int], ...] = ()
    strict: bool = False

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "QuerySpec":
        d = json.loads(text)
        pairs = lambda k: tuple(tuple(x) for x in d.get(k, ()))
        known = {
            "computed": tuple(Computed(**x) for x in d.get("computed", ())), "filters": tuple(Filter(**x) for x in d.get("filters", ())),
            "window": TimeWindow(**d["window"]) if d.get("window") else None, "sort": Sort(**d["sort"]) if d.get("sort") else None,
        }
        lists = {k: tuple(d.get(k, ())) for k in ("unique", "pivot", "hidden", "pinned", "order", "sources")}
        plain = {k: d.get(k) for k in ("delimiter", "columns", "search")} | {k: d.get(k, False) for k in ("tail", "strict")}
        return cls(**known, **lists, **plain, **{k: pairs(k) for k in ("formats", "types", "highlights", "marks")})

    # edits; each returns a new query
    def without_filters(self) -> "QuerySpec":
        return replace(self, filters=())

    def with_filter(self, f: Filter) -> "QuerySpec":
        """A filter on a pivot key takes the key out of the pivot first."""
        return replace(self, filters=(*self.filters, f), pivot=tuple(k for k in self.pivot if k != f.column))

    def search_as_filter(self) -> "QuerySpec":
        return self.with_filter(Filter(self.search)) if self.search else self

    def toggle_key(self, name: str) -> "QuerySpec":
        """A pivot starts sorted by count, largest first, and loses that with its last key."""
        keys = tuple(k for k in self.pivot if k != name) if name in self.pivot else (*self.pivot, name)
        sort = Sort("count", True) if keys and not self.pivot else self.sort if keys else None
        return replace(self, pivot=keys, sort=sort)

    def cycle_sort(self, name: str) -> "QuerySpec":
        """Ascending, then descending, then off."""
        if not self.sort or self.sort.column != name:
            return replace(self, sort=Sort(name))
        return replace(self, sort=None if self.sort.descending else Sort(name, True))

    def cleared(self) -> "QuerySpec":
        """Sort, search and visibility reset; filters stay."""
        return replace(self, sort=None, search=None, columns=None, hidden=(), pinned=(), order=())

    def with_delimiter(self, delimiter: str) -> "QuerySpec":
        """Another delimiter is another table: filters, sort, search and pivot go."""
        return QuerySpec(delimiter=delimiter, tail=self.tail, sources=self.sources, strict=self.strict)

    def without_last_computed(self) -> "QuerySpec":
        """Undo the last split: all columns made from its source by its kind."""
        if not self.computed:
            return self
        last = self.computed[-1]
        keep = list(self.computed)
        while keep and (keep[-1].kind, keep[-1].source, keep[-1].argument) == (last.kind, last.source, last.argument):
            keep.pop()
        return replace(self, computed=tuple(keep))

    def moved(self, columns: list[str], name: str, step: int) -> "QuerySpec":
        """A column swapped with its neighbour, unless one of the two is pinned and the other isn't."""
        order = [c for c in self.order if c in columns] + [c for c in columns if c not in self.order]
        k = order.index(name)
        j = k + step
        if not 0 <= j < len(order) or (order[k] in self.pinned) != (order[j] in self.pinned) or order[j].startswith("_"):
            return self
        order[k], order[j] = order[j], order[k]
        return replace(self, order=tuple(order))


@dataclass
class History:
    """The query in use, and those before views were applied to it."""

    spec: QuerySpec
    start: QuerySpec = QuerySpec()
    before: list[QuerySpec] = field(default_factory=list)

    def apply(self, view: QuerySpec) -> QuerySpec:
        """A view in the place of the query; its sources stay."""
        self.before.append(self.spec)
        self.spec = replace(view, sources=self.spec.sources)
        return self.spec

    def undo(self) -> QuerySpec:
        """Back to the query before the last view; without one nothing changes."""
        if self.before:
            self.spec = self.before.pop()
        return self.spec

    def fresh(self) -> QuerySpec:
        """A query over the same lines as at the start: what the command line asked for."""
        return replace(self.start, sources=self.spec.sources)


CLEAR = ("0", "off", "clear", "none", "")
UNITS = {"d": 86400.0, "h": 3600.0, "m": 60.0, "s": 1.0}


def parse_duration(text: str) -> float | None:
    """Seconds of 1d2h30m15s in any part; a bare number is minutes; None for nothing positive."""
    text = text.strip().lower()
    if re.fullmatch(r"\d+(\.\d+)?", text):
        seconds = float(text) * 60
    elif re.fullmatch(r"(\d+(\.\d+)?[dhms]\s*)+", text):
        seconds = sum(float(n) * UNITS[u] for n, u in re.findall(r"(\d+(?:\.\d+)?)([dhms])", text))
    else:
        return None
    return seconds if seconds > 0 else None


def format_duration(seconds: float) -> str:
    """1d2h3m; seconds only if there is nothing larger."""
    s, out = int(seconds), ""
    for unit, by in (("d", 86400), ("h", 3600), ("m", 60)):
        if s >= by:
            out += f"{s // by}{unit}"
            s %= by
    return out or f"{s}s"


def parse_window(text: str) -> TimeWindow | None:
    """[column ]duration[+]; None clears; SpecError if there is no duration."""
    text = text.strip()
    if text.lower() in CLEAR:
        return None
    column, _, last = text.rpartition(" ")
    seconds = parse_duration(last.rstrip("+"))
    if seconds is None:
        raise SpecError(f"no duration: {text}")
    return TimeWindow(seconds, last.endswith("+"), column.strip() or None)


def parse_filter(text: str, exclude: bool = False) -> Filter:
    """column=pattern; column any means all columns."""
    name, sign, pattern = text.partition("=")
    if not sign or not name:
        raise SpecError(f"a filter is column=pattern: {text}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise SpecError(f"not a pattern: {pattern}: {e}") from e
    return Filter(pattern, None if name == "any" else name, exclude)


def parse_sort(text: str) -> Sort:
    name, sign, way = text.rpartition("=")
    if not sign or way not in ("asc", "desc") or not name:
        raise SpecError(f"a sort is column=asc or column=desc: {text}")
    return Sort(name, way == "desc")


def parse_format(text: str) -> tuple[str, str]:
    """column -> format."""
    name, sign, fmt = text.partition("->")
    if not sign or not name.strip() or not fmt.strip():
        raise SpecError(f"a time format is column -> format: {text}")
    return name.strip(), fmt.strip()


def find_column(name: str, columns: list[str]) -> str:
    """By case-insensitive or quoted name; SpecError names the nearest ones."""
    from difflib import get_close_matches

    bare = name.strip().strip("\"'")
    hit = next((c for c in columns if c == bare), None) or next((c for c in columns if c.lower() == bare.lower()), None)
    if hit is None:
        near = get_close_matches(bare.lower(), [c.lower() for c in columns])
        raise SpecError(f"no column {bare}" + (f"; perhaps {', '.join(near)}" if near else ""))
    return hit


@dataclass
class Store:
    """Saved sessions and views: one JSON file each, replaced in one step."""

    folder: str
    broken: list[str] = field(default_factory=list)

    def _path(self, name: str) -> str:
        return os.path.join(self.folder, re.sub(r"[^\w.-]", "_", name) + ".json")

    def save(self, name: str, spec: QuerySpec) -> str:
        os.makedirs(self.folder, exist_ok=True)
        fd, temp = tempfile.mkstemp(dir=self.folder)
        with os.fdopen(fd, "w") as f:
            json.dump({"name": name, "spec": json.loads(spec.to_json())}, f)
        os.replace(temp, self._path(name))
        return self._path(name)

    def names(self) -> list[str]:
        """Newest first; files that can't be read are left out and listed in broken."""
        self.broken, found = [], []
        for entry in os.scandir(self.folder) if os.path.isdir(self.folder) else ():
            if entry.name.endswith(".json"):
                try:
                    with open(entry.path) as f:
                        found.append((-entry.stat().st_mtime_ns, json.load(f)["name"]))
                except (ValueError, KeyError, OSError):
                    self.broken.append(entry.name)
        return [n for _, n in sorted(found)]

    def load(self, name: str) -> QuerySpec:
        with open(self._path(name)) as f:
            return QuerySpec.from_json(json.dumps(json.load(f)["spec"]))

    def delete(self, name: str) -> None:
        os.remove(self._path(name))

    def rename(self, name: str, new: str) -> None:
        self.save(new, self.load(name))
        self.delete(name)

    def of_source(self, path: str) -> list[str]:
        """Items whose source is this path or has its file name, exact ones first."""
        base = os.path.basename(path)
        found = []
        for n in self.names():
            sources = self.load(n).sources
            if any(x == path or os.path.basename(x) == base for x in sources):
                found.append((path not in sources, n))
        return [n for _, n in sorted(found, key=lambda x: x[0])]
