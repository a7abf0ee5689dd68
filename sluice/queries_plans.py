"""Queries on times, windows and views, and on the query as data, over tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import datetimes, regexes, values
from .operators import columns as cols
from .operators import rows
from .plans.build import build, show
from .plans.spec import Computed, Filter, QuerySpec, Sort, Store, TimeWindow, parse_window


def read(spark: SparkSession, d: str, name: str, key: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.withColumn(rows.ORDER, F.col(key)) if key else df


def plain(df: DataFrame) -> DataFrame:
    return df.drop(rows.ORDER)


# queries over tables


def window_text(spark, d):
    df = read(spark, d, "events", "event_id").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), rows.ORDER)
    return build(QuerySpec(window=parse_window("ts 2d12h"), columns="event_id"), df)[0]


def window_cleared(spark, d):
    return build(QuerySpec(window=parse_window("none"), columns="event_id"), read(spark, d, "events", "event_id").select("event_id", rows.ORDER))[0]


def window_unparsed(spark, d):
    """Rows whose time can't be read stay."""
    t = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return rows.time_window(read(spark, d, "events").select("event_id", t.alias("t")), TimeWindow(86400, False, "t")).select("event_id")


def window_missing_column(spark, d):
    """Without its column a window is on the arrival."""
    df = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias(rows.ARRIVAL))
    now = F.to_timestamp(F.lit("2024-01-10 00:00:00"))
    return rows.time_window(df, TimeWindow(86400, False, "gone"), now=now).select("event_id")


def pivot_by_toggle(spark, d):
    spec = QuerySpec().toggle_key("event_type").toggle_key("user_id").toggle_key("user_id")
    df, _ = build(spec, read(spark, d, "events", "event_id").select("event_id", "event_type", "user_id", rows.ORDER))
    return df.select(*rows.pivot_columns(df, ["event_type"]))


def pivot_revealed(spark, d):
    df, _ = build(QuerySpec(pivot=("event_type",)), read(spark, d, "events", "event_id").select("event_id", "event_type", "user_id", rows.ORDER))
    return df.select(*rows.pivot_columns(df, ["event_type"], True))


def filter_by_search(spark, d):
    spec = QuerySpec(search="low").search_as_filter()
    return build(spec, read(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_orderpriority", rows.ORDER))[0]


def filter_drops_key(spark, d):
    spec = QuerySpec(pivot=("o_orderstatus", "o_orderpriority")).with_filter(Filter("^f$", "o_orderstatus"))
    df, _ = build(spec, read(spark, d, "orders", "o_orderkey").select("o_orderstatus", "o_orderpriority", rows.ORDER))
    return df.select("count", "o_orderpriority")


def filter_literal(spark, d):
    df = read(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit(" (x.y)")).alias("v"))
    return rows.filter_rows(df, (Filter(regexes.literal("5 (x.y)"), "v"),))


def sort_strict(spark, d):
    """With one cell that isn't a number the column sorts as text."""
    v = F.when(F.col("c_custkey") == 3, "n/a").otherwise(F.col("c_custkey").cast("string"))
    df = read(spark, d, "customer", "c_custkey").select("c_custkey", v.alias("v"), rows.ORDER)
    return plain(rows.number_rows(rows.sort_rows(df, Sort("v"), "numeric", strict=True)))


def sort_ties(spark, d):
    """Ties keep their order, also when sorting falls."""
    df = read(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_orderpriority", rows.ORDER)
    return plain(rows.number_rows(rows.sort_rows(df, Sort("o_orderpriority", True), "string"))).select("o_orderkey", "place")


def sort_unknown(spark, d):
    return plain(rows.sort_rows(read(spark, d, "nation", "n_nationkey").select("n_name", rows.ORDER), Sort("gone"), "string"))


def stats_of_filtered(spark, d):
    df, _ = build(QuerySpec(filters=(Filter("click", "event_type"),)), read(spark, d, "events", "event_id").select("event_id", "event_type", "user_id", rows.ORDER))
    return cols.column_stats(df, "user_id").select("count", "distinct", "min", "max")


def stats_shown(spark, d):
    """Counts as they are shown."""
    found = read(spark, d, "events").groupBy("event_type").count().collect()
    return spark.createDataFrame([(r["event_type"], cols.format_number(r["count"])) for r in found], "event_type string, shown string")


def columns_with_arrival(spark, d):
    df = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias(rows.ARRIVAL))
    return cols.with_arrival(df)


def substitute_everywhere(spark, d):
    df = read(spark, d, "orders").select("o_orderstatus", "o_orderpriority", F.col("o_orderkey").cast("string").alias("key"))
    return cols.add_computed(df, cols.substitutions(df, regexes.parse_substitution("s/[0-9o]/#/gi"), None))


def computed_renamed(spark, d):
    made = cols.rename(cols.split_columns("o_orderpriority", "-", "1-URGENT"), {"o_orderpriority-1": "level"})
    return cols.add_computed(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), made).select("o_orderkey", "level")


def regex_named(spark, d):
    pattern = regexes.name_groups(r"(https?)://([^/]+)/(.*)", ["scheme", "host"])
    return cols.add_computed(read(spark, d, "pages").select("page_id", "url"), cols.regex_columns("url", pattern)).select("page_id", "scheme", "host")


def json_list(spark, d):
    df = read(spark, d, "events").select("event_id", F.to_json(F.array("event_type", F.col("user_id").cast("string"))).alias("v"))
    return cols.add_computed(df, cols.json_columns("v", '["a", "b"]')).select("event_id", F.col("`v.0`").alias("kind"), F.col("`v.1`").alias("user"))


def view_search(spark, d):
    view = show(QuerySpec(search="middle|asia", marks=(("a", 2), ("b", 99))), read(spark, d, "region", "r_regionkey").select("r_name", rows.ORDER))
    return view.matches.agg(F.count("*").alias("matches"), F.first("column").alias("column")).withColumn("marks", F.lit(",".join(view.marks))).withColumn("skipped", F.lit(",".join(view.skipped)))


def view_tail(spark, d):
    return show(QuerySpec(tail=True), read(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_custkey", rows.ORDER), last=30).table


def session_applied(spark, d):
    """A saved query with a filter, a computed column, a sort and a choice of columns, found again by its source."""
    store = Store(tempfile.mkdtemp())
    spec = QuerySpec(sources=("customer.parquet",), filters=(Filter("[05]$", "c_custkey"),), computed=(Computed("split", "c_name", "number", "#", index=1),), sort=Sort("c_custkey", True), columns="c_custkey|number")
    store.save("mine", spec)
    (name,) = store.of_source("customer.parquet")
    return plain(build(store.load(name), read(spark, d, "customer", "c_custkey"))[0])


def epoch_cells(spark, d):
    """Ten digits are seconds, thirteen milliseconds, others no time."""
    s = F.unix_timestamp(F.col("ts").cast("timestamp"))
    cell = F.when(F.col("event_id") % 3 == 0, s.cast("string")).when(F.col("event_id") % 3 == 1, (s * 1000).cast("string")).otherwise(F.substring(s.cast("string"), 1, 6))
    return read(spark, d, "events").select("event_id", F.unix_timestamp(datetimes.epoch(cell)).alias("s"))


def relative_times(spark, d):
    now = F.to_timestamp(F.lit("2024-01-20 00:00:00"))
    return read(spark, d, "events").select("event_id", datetimes.relative(F.col("ts").cast("timestamp"), now).alias("ago"))


def numbers(spark, d):
    """Cells that are written as numbers, and those that aren't."""
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, F.concat(F.lit("+"), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit("."), k.cast("string"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit("e1"))).otherwise(F.concat(k.cast("string"), F.lit("x")))
    return read(spark, d, "customer").select("c_custkey", values.number(v).alias("n"), values.looks_numeric(v).alias("numeric"))


#: Fixed formats of times: how Spark writes one, and what of the time survives.
TIMES = {
    "%Y-%m-%d %H:%M:%S,%f": ("yyyy-MM-dd HH:mm:ss,SSS", "second"),
    "%Y-%m-%d %H:%M:%S.%f": ("yyyy-MM-dd HH:mm:ss.SSSSSS", "second"),
    "%b %d %H:%M:%S": ("MMM d HH:mm:ss", "second"),
    "%Y/%m/%d %H:%M:%S": ("yyyy/MM/dd HH:mm:ss", "second"),
    "%m/%d/%Y": ("MM/dd/yyyy", "day"),
    "%d/%m/%Y": ("dd/MM/yyyy", "day"),
    "%Y/%m/%d": ("yyyy/MM/dd", "day"),
    "%b %d, %Y": ("MMM d, yyyy", "day"),
}


def time_query(strptime: str, written: str):
    def query(spark, d):
        cell = F.date_format(F.col("ts").cast("timestamp"), written)
        return read(spark, d, "events").select("event_id", F.unix_timestamp(datetimes.parse(cell, strptime, 2024)).alias("s"))

    return query


def time_name(strptime: str) -> str:
    import re

    return "time_" + re.sub(r"\W+", "_", strptime.replace(",%f", "_comma").replace(".%f", "_point").replace("/", "_slash_")).strip("_").lower()


TABLES = {
    "window_text": "select event_id from events where ts >= (select date_trunc('second', max(ts)) from events) - interval 60 hours and date_trunc('second', ts) >= (select date_trunc('second', max(ts)) from events) - interval 60 hours",
    "window_cleared": "select event_id from events",
    "window_unparsed": "select event_id from events where event_id % 9 = 0 or date_trunc('second', ts) >= (select date_trunc('second', max(ts)) from events where event_id % 9 <> 0) - interval 1 day",
    "window_missing_column": "select event_id from events where ts between timestamp '2024-01-09' and timestamp '2024-01-10'",
    "pivot_by_toggle": "select count(*) as count, event_type from events group by event_type",
    "pivot_revealed": "select count(*) as count, event_type, max(event_id) as event_id, arg_max(user_id, event_id) as user_id from events group by event_type",
    "filter_by_search": "select o_orderkey, o_orderpriority from orders where regexp_matches(o_orderpriority, 'low', 'i') or contains(cast(o_orderkey as varchar), 'low')",
    "filter_drops_key": "select count(*) as count, o_orderpriority from orders where o_orderstatus = 'F' group by o_orderpriority",
    "filter_literal": "select p_partkey, p_brand || ' (x.y)' as v from part where p_brand like '%5'",
    "sort_strict": "select c_custkey, v, row_number() over (order by v collate c, c_custkey) as place from (select c_custkey, case when c_custkey = 3 then 'n/a' else cast(c_custkey as varchar) end v from customer)",
    "sort_ties": "select o_orderkey, row_number() over (order by lower(o_orderpriority) desc, o_orderkey) as place from orders",
    "sort_unknown": "select n_name from nation",
    "stats_of_filtered": "select count(*) as count, count(distinct user_id) as distinct, cast(min(user_id) as double) as min, cast(max(user_id) as double) as max from events where event_type = 'click'",
    "stats_shown": "select event_type, format('{:,}', count(*)) as shown from events group by event_type",
    "columns_with_arrival": "select strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') as arrival, event_id from events",
    "substitute_everywhere": "select regexp_replace(o_orderstatus, '[0-9oO]', '#') as o_orderstatus, regexp_replace(o_orderpriority, '[0-9oO]', '#') as o_orderpriority, regexp_replace(cast(o_orderkey as varchar), '[0-9oO]', '#') as key from orders",
    "computed_renamed": "select o_orderkey, string_split(o_orderpriority, '-')[1] as level from orders",
    "regex_named": "select page_id, regexp_extract(url, '^(https?)://([^/]+)/', 1) as scheme, regexp_extract(url, '^(https?)://([^/]+)/', 2) as host from pages",
    "json_list": "select event_id, event_type as kind, cast(user_id as varchar) as user from events",
    "view_search": "select count(*) as matches, 'r_name' as column, 'a' as marks, 'mark b' as skipped from region where regexp_matches(r_name, 'middle|asia', 'i')",
    "view_tail": "select o_orderkey, o_custkey from orders order by o_orderkey desc limit 30",
    "session_applied": "select c_custkey, coalesce(string_split(c_name, '#')[2], '') as number from customer where c_custkey % 5 = 0",
    "epoch_cells": "select event_id, case when event_id % 3 < 2 then cast(floor(epoch(ts)) as bigint) end as s from events",
    "relative_times": "select event_id, case when s < 0 then 'in the future' when s < 60 then s || 's ago' when s < 3600 then s // 60 || 'm ago' when s < 86400 then s // 3600 || 'h' || case when s % 3600 // 60 > 0 then s % 3600 // 60 || 'm' else '' end || ' ago' else s // 86400 || 'd ago' end as ago from (select event_id, cast(epoch(timestamp '2024-01-20') - floor(epoch(ts)) as bigint) s from events)",
    "numbers": "select c_custkey, case c_custkey % 4 when 0 then cast(c_custkey as double) when 1 then cast('.' || c_custkey as double) when 2 then c_custkey * 10.0::double end as n, c_custkey % 4 < 3 as numeric from customer",
}

SQL = TABLES | {time_name(k): f"select event_id, cast(epoch(date_trunc('{unit}', ts)) as bigint) as s from events" for k, (_, unit) in TIMES.items()}


def queries() -> dict:
    times = {time_name(k): time_query(k, w) for k, (w, _) in TIMES.items()}
    return {name: times.get(name) or globals()[name] for name in (*TABLES, *times)}
