"""Operators on columns: computed ones, visibility, aggregates, search and highlights."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import datetimes
from ..functions.regexes import Substitution, groups_at_start, replace_first, translate
from ..functions.values import json_value, key_value, key_values, number, pair_value, split_part
from ..plans.infer import loads
from ..plans.spec import Computed
from .rows import ARRIVAL, ORDER, cell, data_columns, time_of


# computed columns


def computed_column(c: Computed) -> Column:
    source = cell(c.source)
    if c.kind == "split":
        return split_part(source, c.argument, c.index)
    if c.kind == "regex":
        return list(groups_at_start(source, c.argument).values())[c.index]
    if c.kind == "json":
        return json_value(source, c.argument)
    if c.kind == "kv":
        return key_value(source, c.argument)
    if c.kind == "substitute":
        return replace_first(source, c.argument, c.by, c.ignore_case)
    if c.kind == "time":
        return datetimes.reformat(source, c.argument)
    raise ValueError(f"no computed column of kind {c.kind}")


def add_computed(df: DataFrame, computed: tuple[Computed, ...]) -> DataFrame:
    """In their order, so later ones may use earlier ones, before the metadata columns.

    Names that exist are left alone, but for substitutions and time formats,
    which change their column.  A cell's key=value pairs are found once for all keys.
    """
    pairs: dict[str, str] = {}
    for c in computed:
        if c.source not in df.columns:
            continue
        if c.kind in ("substitute", "time"):
            df = df.withColumn(c.source, computed_column(c))
            pairs.pop(c.source, None)
        elif c.name not in df.columns and c.kind == "kv":
            if c.source not in pairs:
                pairs[c.source] = f"_kv_{len(pairs)}_{c.source}"
                df = df.withColumn(pairs[c.source], key_values(cell(c.source)))
            df = df.withColumn(c.name, pair_value(F.col(f"`{pairs[c.source]}`"), c.argument))
        elif c.name not in df.columns:
            df = df.withColumn(c.name, computed_column(c))
    df = df.drop(*[x for x in df.columns if x.startswith("_kv_")])
    meta = [x for x in df.columns if x not in data_columns(df)]
    return df.select(*[f"`{x}`" for x in (*data_columns(df), *meta)])


def split_columns(source: str, delimiter: str, sample: str) -> tuple[Computed, ...]:
    """source-1, source-2 ... as many as the sample cell has parts; none for a single part."""
    n = len(sample.split(delimiter))
    return tuple(Computed("split", source, f"{source}-{k + 1}", delimiter, k) for k in range(n)) if n > 1 else ()


def regex_columns(source: str, pattern: str) -> tuple[Computed, ...]:
    return tuple(Computed("regex", source, name, pattern, k) for k, name in enumerate(translate(pattern, False).names))


def json_columns(source: str, sample: str) -> tuple[Computed, ...]:
    """source.key for each key, or source.0 for each index, of the sample cell's top level."""
    value = loads(sample)
    keys = list(value) if isinstance(value, dict) else range(len(value)) if isinstance(value, list) else ()
    return tuple(Computed("json", source, f"{source}.{k}", str(k)) for k in keys)


def json_paths(sample: str, prefix: str = "") -> list[str]:
    """Every dotted path in a cell, for a picker."""
    value = loads(sample) if isinstance(sample, str) else sample
    pairs = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ()
    out = []
    for k, v in pairs:
        path = f"{prefix}{k}"
        out.append(path)
        if isinstance(v, (dict, list)):
            out += json_paths(json.dumps(v), path + ".")
    return out


def kv_columns(source: str, sample: str) -> tuple[Computed, ...]:
    """source.key for each key of a sample cell with two pairs or more."""
    keys = list(dict.fromkeys(re.findall(r"([A-Za-z_][\w.\-]*)=", sample)))
    return tuple(Computed("kv", source, f"{source}.{k}", k) for k in keys) if len(keys) > 1 else ()


def substitutions(df: DataFrame, s: Substitution, column: str | None, computed: set[str] = frozenset()) -> tuple[Computed, ...]:
    """The first match in a column's cells, or with g in those of all columns that aren't computed."""
    names = [c for c in data_columns(df) if c not in computed] if s.every_column or column is None else [column]
    return tuple(Computed("substitute", n, argument=s.pattern, by=s.by, ignore_case=s.ignore_case) for n in names)


def rename(computed: tuple[Computed, ...], names: dict[str, str]) -> tuple[Computed, ...]:
    from dataclasses import replace

    return tuple(replace(c, name=names.get(c.name, c.name), source=names.get(c.source, c.source)) for c in computed)


# visibility


def matching_columns(names: list[str], pattern: str) -> list[str]:
    """Those in which the pattern is found, in their own order."""
    hit = re.compile(pattern, re.I).search
    return [n for n in names if hit(n)]


def ordered_columns(names: list[str], patterns: str, pinned: tuple[str, ...] = ()) -> list[str]:
    """Alternatives of a pattern give the order; pinned ones stay; all if nothing matches; all for all."""
    if patterns.strip().lower() == "all":
        return names
    parts = [re.compile(p, re.I) for p in patterns.split("|") if p]
    rank = {n: next((k for k, p in enumerate(parts) if p.search(n)), None) for n in names}
    shown = sorted((n for n in names if rank[n] is not None), key=lambda n: rank[n])
    return [*[n for n in names if n in pinned], *[n for n in shown if n not in pinned]] if shown else names


def arrange(df: DataFrame, hidden: tuple[str, ...] = (), pinned: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> list[str]:
    names = data_columns(df)
    names = [n for n in order if n in names] + [n for n in names if n not in order]
    names = [n for n in names if n in pinned] + [n for n in names if n not in pinned]
    return [n for n in names if n not in hidden]


def with_arrival(df: DataFrame) -> DataFrame:
    """The arrival time as text in front."""
    return df.select(datetimes.arrival_text(F.col(ARRIVAL)).alias("arrival"), *[f"`{c}`" for c in data_columns(df)])


# aggregates


def column_stats(df: DataFrame, name: str, kind: str = "numeric") -> DataFrame:
    """count, distinct, sum, avg, min, max and skipped of a column in one pass."""
    typed = dict(df.dtypes)[name] != "string"
    c = cell(name)
    value = F.col(f"`{name}`").cast("double") if typed else number(c)
    bad = value.isNull() & (F.coalesce(F.trim(c), F.lit("")) != "") if not typed else F.lit(False)
    return df.agg(
        F.count("*").alias("count"), F.count_distinct(F.coalesce(c, F.lit(""))).alias("distinct"), F.sum(value).alias("sum"),
        F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"), F.count_if(bad).alias("skipped"),
    )


def column_stats_time(df: DataFrame, name: str, order: str = ORDER, hint: str | None = None) -> DataFrame:
    """count, distinct, the earliest and latest cells as written (the first of equal ones), and skipped."""
    ts, c = time_of(df, name, hint), cell(name)
    return df.agg(
        F.count("*").alias("count"), F.count_distinct(F.coalesce(c, F.lit(""))).alias("distinct"),
        F.min_by(F.when(ts.isNotNull(), c), F.when(ts.isNotNull(), F.struct(ts, F.col(order)))).alias("earliest"),
        F.min_by(F.when(ts.isNotNull(), c), F.when(ts.isNotNull(), F.struct(-F.unix_micros(ts), F.col(order)))).alias("latest"),
        F.count_if(ts.isNull() & (F.coalesce(F.trim(c), F.lit("")) != "")).alias("skipped"),
    )


def format_number(x: float) -> str:
    return f"{x:,.0f}" if float(x).is_integer() else f"{x:,.4g}"


def value_counts(df: DataFrame, name: str, n: int | None = 20) -> DataFrame:
    """A column's values that aren't empty by how often they occur: the n most frequent, or all."""
    counts = df.filter(F.coalesce(cell(name), F.lit("")) != "").groupBy(cell(name).alias("value")).agg(F.count("*").alias("count"))
    counts = counts.orderBy(F.desc("count"), "value")
    return counts.limit(n) if n else counts


# search and highlights


def search(df: DataFrame, pattern: str, pinned: tuple[str, ...] = (), order: str = ORDER) -> DataFrame:
    """(order, position, column) of each cell in which the pattern is found, outside pinned columns."""
    names = [c for c in data_columns(df) if c not in pinned and c != order]
    p = translate(pattern).flagged
    cells = F.array(*[F.struct(F.lit(k).alias("position"), F.lit(c).alias("column"), F.coalesce(cell(c), F.lit("")).alias("v")) for k, c in enumerate(names)])
    hits = F.filter(cells, lambda x: x["v"].rlike(p))
    return df.select(order, F.explode(hits).alias("h")).select(order, "h.position", "h.column")


def next_match(n: int, now: int, step: int = 1) -> int | None:
    """The next or previous of n matches, round and round."""
    return (now + step) % n if n else None


def highlight(df: DataFrame, patterns: list[tuple[str, str]], names: list[str] | None = None) -> DataFrame:
    """Each match wrapped in <mark class=...>, pattern after pattern."""
    for pattern, colour in patterns:
        java = f"{translate(pattern).flagged}"
        df = df.withColumns({c: F.regexp_replace(cell(c), java, f'<mark class="{colour}">$0</mark>') for c in names or data_columns(df)})
    return df


def highlight_count(df: DataFrame, pattern: str) -> DataFrame:
    """How many rows have a cell that matches."""
    p = translate(pattern).flagged
    hit = F.exists(F.array(*[F.coalesce(cell(c), F.lit("")) for c in data_columns(df)]), lambda c: c.rlike(p))
    return df.agg(F.count_if(hit).alias("rows"))
