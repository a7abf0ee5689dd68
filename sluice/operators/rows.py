"""Operators on rows: filters, windows, dedup, pivot, sort, pages, merge."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import datetimes
from ..functions.regexes import contains, literal, translate
from ..functions.values import looks_numeric, natural_key, number
from ..plans.spec import Filter, Sort, SpecError, TimeWindow

#: Columns that a table carries besides its data.
ORDER, ARRIVAL, SOURCE = "_ord", "_arrival", "_source"
META = (ORDER, ARRIVAL, SOURCE, "_raw", "_ok", "_batch_id")


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META]


def cell(name: str) -> Column:
    return F.col(f"`{name}`").cast("string")


# filters


def predicate(df: DataFrame, f: Filter, strict: bool = False) -> Column:
    """Whether a row passes. A column that isn't there is an error, or with strict rejects every row."""
    if f.column is None:
        pattern = translate(f.pattern, f.ignore_case).flagged
        hit = F.exists(F.array(*[F.coalesce(cell(c), F.lit("")) for c in data_columns(df)]), lambda c: c.rlike(pattern))
    elif f.column not in df.columns:
        if strict:
            return F.lit(False)
        raise SpecError(f"no column {f.column}")
    else:
        hit = contains(cell(f.column), f.pattern, f.ignore_case)
    return ~hit if f.exclude else hit


def filter_rows(df: DataFrame, filters: tuple[Filter, ...], strict: bool = False) -> DataFrame:
    """Rows that pass all filters."""
    return df.filter(reduce(lambda a, b: a & b, [predicate(df, f, strict) for f in filters])) if filters else df


def equals(name: str, value: str, exclude: bool = False) -> Filter:
    """The cell's text and nothing else."""
    return Filter(f"^{literal(value)}$", name, exclude)


def filter_equal(df: DataFrame, name: str, value: str, exclude: bool = False) -> DataFrame:
    """Cells equal to a value but for case, without a pattern."""
    same = F.lower(F.coalesce(cell(name), F.lit(""))) == value.lower()
    return df.filter(~same if exclude else same)


def drill_in(df: DataFrame, keys: dict[str, object]) -> DataFrame:
    """The rows behind a pivot row: equal on all its keys."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(f"`{k}`").eqNullSafe(F.lit(v)) for k, v in keys.items()]))


def excluded_rows(df: DataFrame, shown: list[DataFrame], key: str = ORDER) -> DataFrame:
    """Rows of a source that none of the given tables shows."""
    if not shown:
        return df
    seen = reduce(lambda a, b: a.unionByName(b), [s.select(key) for s in shown])
    return df.join(seen.distinct(), key, "left_anti")


# time windows


def time_of(df: DataFrame, name: str, hint: str | None = None) -> Column:
    kind = dict(df.dtypes)[name]
    c = F.col(f"`{name}`")
    return c.cast("timestamp") if kind.startswith(("timestamp", "date")) else datetimes.parse(c.cast("string"), hint)


def time_window(df: DataFrame, w: TimeWindow, hint: str | None = None, now: Column | None = None, keep_unparsed: bool = True) -> DataFrame:
    """Rows of the last seconds before the largest time, or before now if rolling.

    Rows whose time can't be read stay, unless told otherwise.  A column that is
    missing gives way to the arrival time, where there is one.
    """
    name = w.column if w.column in df.columns else ARRIVAL if ARRIVAL in df.columns else None
    if name is None:
        raise SpecError(f"no column {w.column} and no arrival time")
    now = F.current_timestamp() if now is None else now
    if name == ARRIVAL:
        return within(df, F.col(ARRIVAL), now, w.seconds, not w.rolling)
    ts = time_of(df, name, hint)
    timed = df.withColumn("_t", ts)
    if w.rolling:
        low = now - F.make_dt_interval(secs=F.lit(w.seconds))
        inside = F.col("_t") >= low
    else:
        top = df.select(ts.alias("_t")).agg(F.max("_t").alias("_top")).scalar()  # the largest time of the data
        inside = F.col("_t") >= top - F.make_dt_interval(secs=F.lit(w.seconds))
    return timed.filter(F.col("_t").isNull() | inside if keep_unparsed else inside).select(*df.columns)


def within(df: DataFrame, ts: Column, ceiling: Column, seconds: float, capped: bool) -> DataFrame:
    """Rows between ceiling - seconds and, if capped, the ceiling; later ones count as late."""
    recent = df.filter(ts >= ceiling - F.make_dt_interval(secs=F.lit(seconds)))
    return recent.filter(ts <= ceiling) if capped else recent


# dedup and pivot


def first_per_key(df: DataFrame, keys: list[str], order: str = ORDER) -> DataFrame:
    """The first row of each key in order; keys that aren't there don't count."""
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return df
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*[f"`{k}`" for k in keys]).agg(F.min_by(F.struct(*[f"`{c}`" for c in rest]), F.col(order)).alias("_r"))
    return first.select(*[F.col(f"_r.`{c}`").alias(c) if c in rest else F.col(f"`{c}`") for c in df.columns])


def pivot(df: DataFrame, keys: list[str], order: str = ORDER) -> DataFrame:
    """count and keys first, the other cells of each key's last row, the place of its first as order."""
    rest = [c for c in df.columns if c not in keys and c != order]
    last = F.max_by(F.struct(*[f"`{c}`" for c in rest]), F.col(order)) if rest else F.lit(None)
    out = df.groupBy(*[f"`{k}`" for k in keys]).agg(F.count("*").alias("count"), F.min(order).alias(order), last.alias("_r"))
    return out.select("count", *[f"`{k}`" for k in keys], *[F.col(f"_r.`{c}`").alias(c) for c in rest], order)


def pivot_columns(df: DataFrame, keys: list[str], reveal: bool = False) -> list[str]:
    """The columns of a pivot that are shown: count and keys, or all once new rows reveal the others."""
    return data_columns(df) if reveal else [c for c in ("count", *keys) if c in df.columns]


# sort


#: Orders by whether they descend; what is null comes last either way.
SORT_WAY = {False: lambda c: c.asc_nulls_last(), True: lambda c: c.desc_nulls_last()}


def sort_columns(name: str, kind: str, hint: str | None = None, descending: bool = False, strict_text: bool = False) -> list[tuple[Column, bool]]:
    """(key, whether it descends) in turn: what can't be read as the type comes after, by natural order, blanks last."""
    c = F.coalesce(cell(name), F.lit(""))
    if strict_text:
        return [(c, descending)]
    key = {"numeric": number(c), "datetime": datetimes.parse(c, hint)}.get(kind)
    blank = (F.trim(c) == "", False)
    if key is None:
        return [blank, (natural_key(c), descending)]
    return [blank, (key.isNull(), False), (key, descending), (F.when(key.isNull(), natural_key(c)), descending)]


def unused(df: DataFrame, name: str) -> str:
    """The name, or one made of it, that no column of df has in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sort_rows(df: DataFrame, s: Sort, kind: str, hint: str | None = None, strict: bool = False, order: str = ORDER) -> DataFrame:
    """Sorted by one column, ties in their own order both ways; an unknown column sorts nothing.

    With strict, one cell that isn't numeric makes the whole column sort as text.
    """
    if s.column not in df.columns:
        return df
    if dict(df.dtypes)[s.column] not in ("string",):
        c = F.col(f"`{s.column}`")
        return df.orderBy(c.desc_nulls_last() if s.descending else c.asc_nulls_last(), order)
    text = strict and kind == "numeric" and not df.agg(F.bool_and(looks_numeric(cell(s.column)))).first()[0]
    keys = sort_columns(s.column, kind, hint, s.descending, text)
    names = [unused(df, f"_sort{k}") for k in range(len(keys))]
    # as columns, since a sort evaluates its expressions at every comparison
    keyed = df.withColumns({name: c for name, (c, _) in zip(names, keys)})
    return keyed.orderBy(*[SORT_WAY[down](F.col(name)) for name, (_, down) in zip(names, keys)], order).drop(*names)


def number_rows(df: DataFrame, name: str = "place") -> DataFrame:
    """A table in its order with the number of each row from 1 on, no row moved.

    The parts of the sorted table are written to the checkpoint folder, numbered
    apart, and offset by the sizes of the parts before, one row for each part.
    """
    folder = work_folder(df.sparkSession)
    df.withColumn("_part", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).write.parquet(folder)
    kept = df.sparkSession.read.parquet(folder)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return kept.join(F.broadcast(sizes), "_part").withColumn(name, F.col("_before") + F.col("_k") + 1).drop("_part", "_k", "_before")


def work_folder(spark) -> str:
    """A new folder below ``spark.checkpoint.dir``; only a local session may have none, and gets a temporary one."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sluice-"))
        base = sc.getCheckpointDir()
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


def page(df: DataFrame, start: int, n: int, order: str = ORDER) -> DataFrame:
    return df.orderBy(order).offset(start).limit(n)


def row_at(total: int, target: str) -> int:
    """The row of N (from 1) or N%, within the table."""
    k = round(total * float(target[:-1]) / 100) if target.endswith("%") else int(target)
    return max(0, min(total - 1, k - (0 if target.endswith("%") else 1)))


def tail(df: DataFrame, n: int, order: str = ORDER) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(n)


# merge


def merge(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Both with a source label, in the left one's columns, by arrival and then side and place."""

    def labelled(df: DataFrame, name: str, side: int) -> DataFrame:
        source = F.coalesce(F.col(SOURCE), F.lit(name)) if SOURCE in df.columns else F.lit(name)
        arrival = F.col(ARRIVAL) if ARRIVAL in df.columns else F.lit(None).cast("timestamp")
        order = F.col(ORDER) if ORDER in df.columns else F.lit(0).cast("long")
        cells = [F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in data_columns(left)]
        return df.select(*cells, source.alias(SOURCE), arrival.alias(ARRIVAL), F.struct(F.lit(side), order).alias(ORDER))

    return labelled(left, names[0], 0).unionByName(labelled(right, names[1], 1))
