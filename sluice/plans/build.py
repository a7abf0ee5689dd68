"""A query on a table: one lazy DataFrame in the order of the batch pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import datetimes
from ..operators import columns as cols
from ..operators import rows
from .infer import column_type
from .spec import QuerySpec

#: Rows from which column types are inferred.
SAMPLE = 100


def types_of(df: DataFrame, names: list[str], overrides: dict[str, str] | None = None) -> dict[str, tuple[str, str | None]]:
    """Types of text columns from rows at the table's beginning, all in one small read.

    Reading ends after as many rows as are looked at; they aren't sorted, which would read the whole table.
    """
    names = [n for n in dict.fromkeys(names) if n in df.columns]
    text = [n for n in names if dict(df.dtypes)[n] == "string"]
    sample = df.select(*[f"`{n}`" for n in text]).limit(SAMPLE).collect() if text else []
    out = {n: column_type(n, [r[n] or "" for r in sample], (overrides or {}).get(n)) for n in text}
    for n in names:
        if n not in out:
            kind = dict(df.dtypes)[n]
            out[n] = ("datetime" if kind.startswith(("timestamp", "date")) else "numeric", None)
    return out


def build(spec: QuerySpec, df: DataFrame, now=None) -> tuple[DataFrame, list[str]]:
    """The result, and what of the query had to be skipped because its column isn't there.

    Order: computed columns, filters, time window, unique, pivot, sort, time
    formats, highlights, columns.  Sorting sees times as they were written.
    """
    skipped: list[str] = []
    if rows.ORDER not in df.columns:
        df = df.withColumn(rows.ORDER, F.monotonically_increasing_id())
    skipped += [f"computed {c.name or c.source}" for c in spec.computed if c.source not in df.columns and c.source not in {x.name for x in spec.computed}]
    df = cols.add_computed(df, spec.computed)
    has = lambda n: n is None or n in df.columns
    skipped += [f"filter {f.column}" for f in spec.filters if not has(f.column) and not spec.strict]
    df = rows.filter_rows(df, tuple(f for f in spec.filters if has(f.column) or spec.strict), spec.strict)
    wanted = [spec.window and spec.window.column, spec.sort and spec.sort.column, *[c for c, _ in spec.formats]]
    types = types_of(df, [n for n in wanted if n], dict(spec.types))
    if spec.window:
        df = rows.time_window(df, spec.window, types.get(spec.window.column, ("", None))[1], now)
    if spec.unique:
        df = rows.first_per_key(df, list(spec.unique))
    keys = [k for k in spec.pivot if k in df.columns]
    skipped += [f"pivot {k}" for k in spec.pivot if k not in keys]
    if keys:
        df = rows.pivot(df, keys)
    if spec.sort and spec.sort.column in df.columns:
        kind, hint = types.get(spec.sort.column) or types_of(df, [spec.sort.column])[spec.sort.column]
        df = rows.sort_rows(df, spec.sort, kind, hint, spec.strict)
    elif spec.sort:
        skipped.append(f"sort {spec.sort.column}")
    formats = [(c, f) for c, f in spec.formats if c in df.columns]
    skipped += [f"format {c}" for c, _ in spec.formats if c not in df.columns]
    for name, target in formats:
        df = df.withColumn(name, datetimes.reformat(rows.cell(name), target, types[name][1] if name in types else None, now=now))
    if spec.highlights:
        df = cols.highlight(df, list(spec.highlights))
    names = cols.arrange(df, spec.hidden, spec.pinned, spec.order)
    if spec.columns:
        names = cols.ordered_columns(names, spec.columns, spec.pinned)
    return df.select(*[f"`{n}`" for n in names]), skipped


@dataclass
class View:
    """What a query shows: its table, what had to be skipped, the places where its search hits, and its marked rows."""

    table: DataFrame
    skipped: list[str]
    matches: DataFrame | None = None
    marks: dict[str, int] = field(default_factory=dict)


def show(spec: QuerySpec, df: DataFrame, now=None, last: int = 1000) -> View:
    """All of a query: ``build``, then the last rows if it follows the tail, then search and marks.

    Marks are rows by number; those beyond the table are skipped and said so.
    """
    keep = df if rows.ORDER in df.columns else df.withColumn(rows.ORDER, F.monotonically_increasing_id())
    table, skipped = build(spec, keep, now)
    if spec.tail and not (spec.pivot or spec.sort):
        ordered, _ = build(replace(spec, columns=None), rows.tail(keep, last), now) if not (spec.filters or spec.unique or spec.window) else (table, skipped)
        table = ordered.select(*table.columns)
    matches = None
    if spec.search:
        numbered = table.withColumn(rows.ORDER, F.monotonically_increasing_id())
        matches = cols.search(numbered, spec.search, spec.pinned)
    marks = dict(spec.marks)
    if marks:
        n = table.count()
        skipped += [f"mark {k}" for k, row in marks.items() if row >= n]
        marks = {k: row for k, row in marks.items() if row < n}
    return View(table, skipped, matches, marks)
