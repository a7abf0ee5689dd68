"""Queries over the driver's tables, one for each group of operators, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import queries_plans, queries_sources, queries_streams
from .functions import datetimes
from .functions.regexes import replace_first
from .operators import columns as cols
from .operators import rows
from .plans import logformats
from .plans.build import build, types_of
from .plans.infer import Layout
from .plans.spec import Computed, Filter, QuerySpec, Sort, TimeWindow
from .sources import sinks, text

UTC = "yyyy-MM-dd HH:mm:ss"


def read(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn(rows.ORDER, F.col(key)) if key else df


def without_order(df: DataFrame) -> DataFrame:
    return df.drop(rows.ORDER)


def pivot_count(spark, d):
    df = rows.filter_rows(read(spark, d, "events", "event_id").select("event_id", "event_type", "user_id", "value", rows.ORDER), (Filter("^(click|VIEW|pur)", "event_type"),))
    out = rows.pivot(df, ["event_type"])
    return out.orderBy(F.desc("count"), rows.ORDER).select("event_type", "count", F.col("value").alias("last_value"), F.col("event_id").alias("last_event"), F.col(rows.ORDER).alias("first_event"))


def dedup_first(spark, d):
    return without_order(rows.first_per_key(read(spark, d, "events", "event_id").select("event_id", "user_id", "event_type", "value", rows.ORDER), ["user_id", "event_type", "no_such"]))


def filter_column(spark, d):
    return rows.filter_rows(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), (Filter("urgent|^2", "o_orderpriority"),))


def filter_any(spark, d):
    return rows.filter_rows(read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), (Filter("low|99"),))


def filter_exclude(spark, d):
    return rows.filter_rows(read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), (Filter("high", "o_orderpriority", True), Filter("f", "o_orderstatus")))


def filter_equals(spark, d):
    return rows.filter_equal(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "1-urgent")


def filter_unknown(spark, d):
    return rows.filter_rows(read(spark, d, "nation").select("n_nationkey", "n_name"), (Filter("a", "no_such", True),), strict=True)


def drill_in(spark, d):
    return rows.drill_in(read(spark, d, "events").select("event_id", "event_type", "user_id"), {"event_type": "error"})


def excluded_rows(spark, d):
    df = read(spark, d, "events", "event_id").select("event_id", "event_type", "value", rows.ORDER)
    shown = [rows.filter_rows(df, (Filter("click", "event_type"),)), rows.filter_rows(df, (Filter("view", "event_type"),))]
    return without_order(rows.excluded_rows(df, shown))


def substitute_first(spark, d):
    return read(spark, d, "orders").select("o_orderkey", replace_first(F.col("o_orderpriority"), "([a-z])([a-z])", r"<\2\1>", True).alias("changed"))


def split_literal(spark, d):
    made = cols.split_columns("o_orderpriority", "-", "1-URGENT")
    return cols.add_computed(read(spark, d, "orders").select("o_orderkey", "o_orderpriority"), made).withColumnsRenamed({"o_orderpriority-1": "part_1", "o_orderpriority-2": "part_2"})


def regex_extract(spark, d):
    made = cols.regex_columns("url", r"(?P<scheme>https?)://(?P<host>[^/]+)/(?P<rest>.*)")
    return cols.add_computed(read(spark, d, "pages").select("page_id", "url"), made)


def json_path(spark, d):
    df = read(spark, d, "events").select("event_id", F.to_json(F.struct(F.struct("props", F.array("event_type", F.lit("z")).alias("l")).alias("a"))).alias("doc"))
    made = (Computed("json", "doc", "second", "a.l.1"), Computed("json", "doc", "kind", "a.l.0"), Computed("json", "doc", "none", "a.x"))
    return cols.add_computed(df, made).drop("doc")


def json_expand(spark, d):
    made = cols.json_columns("props", '{"k": 1}')
    return cols.add_computed(read(spark, d, "events").select("event_id", "props"), made).select("event_id", F.col("`props.k`").alias("k"))


def nested_split(spark, d):
    made = (Computed("split", "props", "after", ":", 1), Computed("regex", "after", "digits", r"\D*(\d+)"))
    return cols.add_computed(read(spark, d, "events").select("event_id", "props"), made).select("event_id", "digits")


def kv_extract(spark, d):
    df = read(spark, d, "events").select("event_id", F.concat(F.lit("id=0 kind="), F.col("event_type"), F.lit(' label="a '), F.col("event_type"), F.lit('" id='), F.col("user_id").cast("string")).alias("line"))
    made = cols.kv_columns("line", "id=1 kind=a label=b")
    return cols.add_computed(df, made).select("event_id", F.col("`line.id`").alias("id"), F.col("`line.kind`").alias("kind"), F.col("`line.label`").alias("label"))


def ts_text(spark, d):
    return read(spark, d, "events").select("event_id", F.date_format("ts", UTC).alias("ts"))


def ts_epoch(spark, d):
    return ts_text(spark, d).select("event_id", datetimes.reformat(F.col("ts"), "epoch").alias("s"), datetimes.reformat(F.col("ts"), "epoch_ms").alias("ms"))


def ts_format(spark, d):
    return ts_text(spark, d).select("event_id", datetimes.reformat(F.col("ts"), "%d.%m.%Y %H:%M").alias("t"), datetimes.reformat(F.col("ts"), "iso").alias("iso"))


def ts_timezone(spark, d):
    return ts_text(spark, d).select("event_id", datetimes.reformat(F.col("ts"), "UTC>US/Eastern %Y-%m-%d %H:%M:%S").alias("t"))


def window_column(spark, d):
    df = read(spark, d, "events").select("event_id", "ts", "value")
    return rows.time_window(df, TimeWindow(86400 * 2, False, "ts")).select("event_id", "value")


def window_rolling(spark, d):
    df = read(spark, d, "events").select("event_id", "ts")
    now = F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    return rows.time_window(df, TimeWindow(86400, True, "ts"), now=now).select("event_id")


def window_arrival(spark, d):
    df = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias(rows.ARRIVAL))
    return rows.within(df, F.col(rows.ARRIVAL), F.to_timestamp(F.lit("2024-01-03 00:00:00")), 86400, True).select("event_id")


def column_stats(spark, d):
    return cols.column_stats(read(spark, d, "lineitem"), "l_quantity")


def column_stats_text(spark, d):
    text_cell = F.when(F.col("c_acctbal") < 0, "N/A").otherwise(F.col("c_custkey").cast("string"))
    return cols.column_stats(read(spark, d, "customer").select(text_cell.alias("v")), "v")


def column_stats_time(spark, d):
    df = read(spark, d, "events", "event_id").select(rows.ORDER, F.date_format("ts", UTC).alias("t"))
    return cols.column_stats_time(df, "t")


def value_freq(spark, d):
    return cols.value_counts(read(spark, d, "orders"), "o_orderpriority")


def placed(df: DataFrame, sort: Sort, kind: str, hint: str | None = None) -> DataFrame:
    """The sorted table with each row's place in it."""
    return without_order(rows.number_rows(rows.sort_rows(df, sort, kind, hint)))


def sort_numeric(spark, d):
    df = read(spark, d, "part", "p_partkey").select("p_partkey", F.col("p_size").cast("string").alias("size"), rows.ORDER)
    return placed(df, Sort("size", True), "numeric")


def sort_natural(spark, d):
    return placed(read(spark, d, "part", "p_partkey").select("p_partkey", "p_brand", rows.ORDER), Sort("p_brand"), "string")


def sort_mixed(spark, d):
    v = F.when(F.col("c_custkey") % 7 == 0, "").when(F.col("c_custkey") % 5 == 0, "n/a").otherwise(F.col("c_custkey").cast("string"))
    return placed(read(spark, d, "customer", "c_custkey").select("c_custkey", v.alias("v"), rows.ORDER), Sort("v"), "numeric")


def sort_datetime(spark, d):
    df = read(spark, d, "orders", "o_orderkey").select("o_orderkey", F.date_format("o_orderdate", "dd/MMM/yyyy:HH:mm:ss '+0000'").alias("t"), rows.ORDER)
    return placed(df, Sort("t", True), "datetime", "%d/%b/%Y:%H:%M:%S %z").select("o_orderkey", "place")


def tail_rows(spark, d):
    return without_order(rows.tail(read(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_totalprice", rows.ORDER), 25))


def page_rows(spark, d):
    return without_order(rows.page(read(spark, d, "orders", "o_orderkey").select("o_orderkey", rows.ORDER), 100, 50))


def columns_regex(spark, d):
    df = read(spark, d, "customer")
    return df.select(*cols.matching_columns(df.columns, "KEY|bal"))


def columns_order(spark, d):
    df = read(spark, d, "customer")
    return df.select(*cols.ordered_columns(df.columns, "bal|key", ("c_name",)))


def as_text(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def parsed_back(df: DataFrame, delimiter: str, fmt: str) -> DataFrame:
    """A table written as lines and read again by their layout."""
    lines = sinks.lines(df, fmt)[1].withColumnRenamed("value", "_raw").withColumn(rows.ORDER, F.monotonically_increasing_id())
    return text.parse(lines, Layout(delimiter, tuple(df.columns), None)).select(*df.columns, F.col("_ok").alias("ok"))


def orders_text(spark, d):
    return as_text(read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.concat(F.col("o_orderpriority"), F.lit(', "x"')).alias("o_note"), "o_custkey"))


def csv_roundtrip(spark, d):
    return parsed_back(orders_text(spark, d), ",", "csv")


def tsv_roundtrip(spark, d):
    return parsed_back(as_text(read(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_custkey")), "\t", "raw")


def json_roundtrip(spark, d):
    return parsed_back(orders_text(spark, d), "json", "json")


def aligned_roundtrip(spark, d):
    df = as_text(read(spark, d, "part").select("p_partkey", "p_brand", "p_size"))
    line = F.concat(F.rpad("p_partkey", 12, " "), F.rpad("p_brand", 14, " "), F.col("p_size"))
    lines = df.select(line.alias("_raw"), F.monotonically_increasing_id().alias(rows.ORDER))
    names = ("p_partkey", "p_brand", "p_size")
    by_blanks = text.parse(lines, Layout("  ", names, None)).select(*names)
    by_place = text.parse(lines, Layout(" ", names, None, (0, 12, 26))).select(*names)
    by_space = text.parse(lines, Layout(" ", names, None, (), 3)).select(*names)
    return by_blanks.union(by_place).union(by_space).groupBy(*names).agg(F.count("*").alias("ways"))


def log_of(spark, d, line, name: str, keep: list[str]) -> DataFrame:
    lines = read(spark, d, "events", "event_id").select(F.concat_ws("", *line).alias("_raw"), rows.ORDER)
    fmt = next(f for f in logformats.FORMATS if f.name == name)
    parsed = text.parse(lines, Layout(fmt.pattern, fmt.columns, None))
    return parsed.filter("_ok").select(F.col(rows.ORDER).alias("event_id"), *keep)


def log_combined(spark, d):
    v = [F.lit("10.0.0.1 - u"), F.col("user_id").cast("string"), F.lit(" [01/Jan/2024:00:00:00 +0000] \"GET /"), F.col("event_type"), F.lit(' HTTP/1.1" 200 '), F.col("event_id").cast("string"), F.lit(' "-" "agent"')]
    return log_of(spark, d, v, "Apache/nginx Combined", ["ip", "user", "method", "path", "protocol", "status", "size", "referer", "useragent"])


def log_syslog(spark, d):
    v = [F.lit("<34>1 2024-01-01T00:00:00Z host"), F.col("user_id").cast("string"), F.lit(" app 77 - - "), F.col("event_type")]
    return log_of(spark, d, v, "Syslog (RFC 5424)", ["priority", "version", "host", "app", "procid", "msgid", "message"])


def log_python(spark, d):
    v = [F.date_format("ts", UTC), F.lit(",123 - app."), F.col("event_type"), F.lit(" - INFO - user "), F.col("user_id").cast("string")]
    return log_of(spark, d, v, "Python Logging Dash", ["timestamp", "logger", "level", "message"])


def merge_sources(spark, d):
    left = read(spark, d, "supplier", "s_suppkey").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), rows.ORDER)
    right = read(spark, d, "customer", "c_custkey").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), rows.ORDER)
    return rows.merge(left, right, ("supplier", "customer")).select("name", "nation", F.col(rows.SOURCE).alias("source"))


def search_matches(spark, d):
    df = read(spark, d, "orders", "o_orderkey").select(rows.ORDER, "o_orderstatus", "o_orderpriority")
    out = cols.search(df, "o|f")
    return out.select(F.col(rows.ORDER).alias("o_orderkey"), "position", "column")


def highlight_cells(spark, d):
    df = read(spark, d, "nation").select("n_nationkey", "n_name")
    return cols.highlight(df, [("a", "red")], ["n_name"])


def highlight_rows(spark, d):
    return cols.highlight_count(read(spark, d, "orders").select("o_orderstatus", "o_orderpriority"), "high")


def sink_lines(spark, d):
    df = read(spark, d, "nation").select("n_nationkey", "n_name")
    parts = [sinks.lines(df, fmt)[1].select(F.lit(fmt).alias("format"), F.col("value").alias("line")) for fmt in ("csv", "json", "raw", "markdown", "html")]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def infer_types(spark, d):
    df = as_text(read(spark, d, "orders")).withColumn(rows.ORDER, F.col("o_orderkey").cast("long"))
    found = types_of(df, [c for c in df.columns if c != rows.ORDER])
    return spark.createDataFrame([(c, k, h or "") for c, (k, h) in found.items()], "column string, type string, hint string")


def query_spec(spark, d):
    spec = QuerySpec(
        computed=(Computed("split", "o_orderpriority", "level", "-", 0),), filters=(Filter("^[of]$", "o_orderstatus"),),
        pivot=("level", "o_orderstatus"), sort=Sort("count", True), columns="count|level|status",
    )
    df = read(spark, d, "orders", "o_orderkey").select("o_orderkey", "o_orderstatus", "o_orderpriority", rows.ORDER)
    return build(QuerySpec.from_json(spec.to_json()), df)[0]


#: The share of numbers and of times among the first 100 cells of each column.
INFER_TYPES = " union all ".join(
    f"select '{c}' as column, case when avg(cast(regexp_full_match(v, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') as int)) >= 0.8 then 'numeric' "
    f"when avg(cast(try_cast(v as timestamp) is not null as int)) >= 0.8 then 'datetime' else 'string' end as type, '' as hint "
    f"from (select cast({c} as varchar) v from orders order by o_orderkey limit 100)"
    for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
)

SQL = {
    "pivot_count": "select event_type, count(*) as count, arg_max(value, event_id) as last_value, max(event_id) as last_event, min(event_id) as first_event from events where regexp_matches(event_type, '^(click|VIEW|pur)', 'i') group by event_type",
    "dedup_first": "select event_id, user_id, event_type, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1",
    "filter_column": "select o_orderkey, o_orderpriority from orders where regexp_matches(o_orderpriority, 'urgent|^2', 'i')",
    "filter_any": "select o_orderkey, o_orderstatus, o_orderpriority from orders where regexp_matches(cast(o_orderkey as varchar), 'low|99', 'i') or regexp_matches(o_orderstatus, 'low|99', 'i') or regexp_matches(o_orderpriority, 'low|99', 'i')",
    "filter_exclude": "select o_orderkey, o_orderpriority, o_orderstatus from orders where not regexp_matches(o_orderpriority, 'high', 'i') and regexp_matches(o_orderstatus, 'f', 'i')",
    "filter_equals": "select o_orderkey, o_orderpriority from orders where lower(o_orderpriority) = '1-urgent'",
    "filter_unknown": "select n_nationkey, n_name from nation where false",
    "drill_in": "select event_id, event_type, user_id from events where event_type = 'error'",
    "excluded_rows": "select event_id, event_type, value from events where event_type not in ('click', 'view')",
    "substitute_first": r"select o_orderkey, regexp_replace(o_orderpriority, '([a-z])([a-z])', '<\2\1>', 'i') as changed from orders",
    "split_literal": "select o_orderkey, o_orderpriority, coalesce(string_split(o_orderpriority, '-')[1], '') as part_1, coalesce(string_split(o_orderpriority, '-')[2], '') as part_2 from orders",
    "regex_extract": "select page_id, url, regexp_extract(url, '^(https?)://([^/]+)/(.*)', 1) as scheme, regexp_extract(url, '^(https?)://([^/]+)/(.*)', 2) as host, regexp_extract(url, '^(https?)://([^/]+)/(.*)', 3) as rest from pages",
    "json_path": "select event_id, 'z' as second, event_type as kind, '' as none from events",
    "json_expand": "select event_id, coalesce(json_extract_string(props, '$.k'), '') as k from events",
    "nested_split": r"select event_id, regexp_extract(coalesce(string_split(props, ':')[2], ''), '^\D*(\d+)', 1) as digits from events",
    "kv_extract": "select event_id, cast(user_id as varchar) as id, event_type as kind, 'a ' || event_type as label from events",
    "ts_epoch": "select event_id, cast(cast(floor(epoch(ts)) as bigint) as varchar) as s, cast(cast(floor(epoch(ts)) as bigint) * 1000 as varchar) as ms from events",
    "ts_format": "select event_id, strftime(ts, '%d.%m.%Y %H:%M') as t, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events",
    "ts_timezone": "select event_id, strftime(timezone('US/Eastern', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') as t from events",
    "window_column": "select event_id, value from events where ts >= (select max(ts) from events) - interval 2 days",
    "window_rolling": "select event_id from events where ts >= timestamp '2024-01-02 00:00:00'",
    "window_arrival": "select event_id from events where ts between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-03 00:00:00'",
    "column_stats": "select count(*) as count, count(distinct l_quantity) as distinct, sum(l_quantity) as sum, avg(l_quantity) as avg, min(l_quantity) as min, max(l_quantity) as max, cast(0 as bigint) as skipped from lineitem",
    "column_stats_text": "select count(*) as count, count(distinct case when c_acctbal < 0 then 'N/A' else cast(c_custkey as varchar) end) as distinct, sum(cast(c_custkey as double)) filter (c_acctbal >= 0) as sum, avg(cast(c_custkey as double)) filter (c_acctbal >= 0) as avg, min(cast(c_custkey as double)) filter (c_acctbal >= 0) as min, max(cast(c_custkey as double)) filter (c_acctbal >= 0) as max, count(*) filter (c_acctbal < 0) as skipped from customer",
    "column_stats_time": "select count(*) as count, count(distinct strftime(ts, '%Y-%m-%d %H:%M:%S')) as distinct, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) as earliest, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) as latest, cast(0 as bigint) as skipped from events",
    "value_freq": "select o_orderpriority as value, count(*) as count from orders group by 1",
    "sort_numeric": "select p_partkey, cast(p_size as varchar) as size, cast(row_number() over (order by p_size desc, p_partkey) as bigint) as place from part",
    "sort_natural": r"select p_partkey, p_brand, cast(row_number() over (order by regexp_extract(p_brand, '^\D*'), cast(regexp_extract(p_brand, '\d+') as int), p_partkey) as bigint) as place from part",
    "sort_mixed": "select c_custkey, v, cast(row_number() over (order by v = '', v = 'n/a', try_cast(v as double), c_custkey) as bigint) as place from (select c_custkey, case when c_custkey % 7 = 0 then '' when c_custkey % 5 = 0 then 'n/a' else cast(c_custkey as varchar) end as v from customer)",
    "sort_datetime": "select o_orderkey, cast(row_number() over (order by date_trunc('second', o_orderdate) desc, o_orderkey) as bigint) as place from orders",
    "tail_rows": "select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 25",
    "page_rows": "select o_orderkey from orders order by o_orderkey limit 50 offset 100",
    "columns_regex": "select c_custkey, c_nationkey, c_acctbal from customer",
    "columns_order": "select c_name, c_acctbal, c_custkey, c_nationkey from customer",
    "csv_roundtrip": "select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, o_orderpriority || ', \"x\"' as o_note, cast(o_custkey as varchar) as o_custkey, true as ok from orders",
    "tsv_roundtrip": "select cast(o_orderkey as varchar) as o_orderkey, o_orderpriority, cast(o_custkey as varchar) as o_custkey, true as ok from orders",
    "json_roundtrip": "select cast(o_orderkey as varchar) as o_orderkey, o_orderstatus, o_orderpriority || ', \"x\"' as o_note, cast(o_custkey as varchar) as o_custkey, true as ok from orders",
    "aligned_roundtrip": "select cast(p_partkey as varchar) as p_partkey, p_brand, cast(p_size as varchar) as p_size, cast(3 as bigint) as ways from part",
    "log_combined": "select event_id, '10.0.0.1' as ip, 'u' || cast(user_id as varchar) as user, 'GET' as method, '/' || event_type as path, 'HTTP/1.1' as protocol, '200' as status, cast(event_id as varchar) as size, '-' as referer, 'agent' as useragent from events",
    "log_syslog": "select event_id, '34' as priority, '1' as version, 'host' || cast(user_id as varchar) as host, 'app' as app, '77' as procid, '-' as msgid, event_type as message from events",
    "log_python": "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',123' as timestamp, 'app.' || event_type as logger, 'INFO' as level, 'user ' || cast(user_id as varchar) as message from events",
    "merge_sources": "select s_name as name, s_nationkey as nation, 'supplier' as source from supplier union all select c_name, c_nationkey, 'customer' from customer",
    "search_matches": "select o_orderkey, cast(0 as int) as position, 'o_orderstatus' as column from orders where regexp_matches(o_orderstatus, 'o|f', 'i') union all select o_orderkey, cast(1 as int), 'o_orderpriority' from orders where regexp_matches(o_orderpriority, 'o|f', 'i')",
    "highlight_cells": "select n_nationkey, regexp_replace(n_name, '(a)', '<mark class=\"red\">\\1</mark>', 'gi') as n_name from nation",
    "highlight_rows": "select count(*) filter (regexp_matches(o_orderstatus, 'high', 'i') or regexp_matches(o_orderpriority, 'high', 'i')) as rows from orders",
    "sink_lines": "with w as (select greatest(11, max(length(cast(n_nationkey as varchar)))) a, greatest(6, max(length(n_name))) b from nation) select 'csv' as format, cast(n_nationkey as varchar) || ',' || n_name as line from nation union all select 'json', '{\"n_nationkey\":\"' || cast(n_nationkey as varchar) || '\",\"n_name\":\"' || n_name || '\"}' from nation union all select 'raw', cast(n_nationkey as varchar) || chr(9) || n_name from nation union all select 'markdown', '| ' || rpad(cast(n_nationkey as varchar), cast(a as int), ' ') || ' | ' || rpad(n_name, cast(b as int), ' ') || ' |' from nation, w union all select 'html', '<tr><td>' || cast(n_nationkey as varchar) || '</td><td>' || n_name || '</td></tr>' from nation",
    "infer_types": INFER_TYPES,
    "query_spec": "select count(*) as count, left(o_orderpriority, 1) as level, o_orderstatus from orders where o_orderstatus in ('O', 'F') group by 2, 3",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL} | queries_sources.queries() | queries_plans.queries() | queries_streams.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | queries_sources.SQL | queries_plans.SQL | queries_streams.SQL
