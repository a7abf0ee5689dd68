"""Queries that start from files, pipes and streams: tables written as text and opened again."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.rows import ORDER, work_folder
from .plans import logformats
from .plans.infer import Layout
from .plans.spec import Filter, QuerySpec, Sort
from .sources import sinks, text
from .streaming import live
from .streaming.growing import store

#: Bytes that are copied at once.
COPIED = 8 << 20


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def customers(spark, d) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("string").alias("nation"))


def one_file(spark: SparkSession, lines: DataFrame, header: list[str] = (), order: str = "n") -> str:
    """Lines (n, value) by n, after the header, as a folder with one file.

    Ranges of n are sorted and written by tasks of their own; one task then copies their
    bytes one after the other and holds no more than COPIED of them.  Only on a file system
    that pyarrow can't open does one task sort all lines.
    """
    folder, parts = work_folder(spark), work_folder(spark)
    head = spark.createDataFrame([(k - len(header), x) for k, x in enumerate(header)], "n long, value string")
    rows = head.unionByName(lines.select(F.col(order).cast("long").alias("n"), "value"))
    if not text.documents.opens(folder):
        rows.coalesce(1).sortWithinPartitions("n").select("value").write.text(folder)
        return folder
    rows.orderBy("n").select("value").write.text(parts)
    system, where = store(folder)
    system.create_dir(where)
    found = system.get_file_info(FileSelector(store(parts)[1]))
    numbered = [(re.match(r"part-(\d+)", x.base_name), x.path) for x in found]
    paths = [path for _, path in sorted((int(m[1]), path) for m, path in numbered if m)]

    def copy(batches):
        for _ in batches:
            unfinished = f"{where}/_{uuid.uuid4().hex}"
            with system.open_output_stream(unfinished) as out:
                for path in paths:
                    with system.open_input_stream(path) as part:
                        while data := part.read(COPIED):
                            out.write(data)
            system.move(unfinished, f"{where}/part-00000.txt")
            yield pa.RecordBatch.from_pydict({"id": pa.array([0], pa.int64())})

    spark.range(1, numPartitions=1).mapInArrow(copy, "id long").collect()
    return folder


def joined(df: DataFrame, sep: str) -> DataFrame:
    return df.select(F.col(df.columns[0]).cast("long").alias("n"), F.concat_ws(sep, *df.columns).alias("value"))


def opened(spark, d, sep: str) -> DataFrame:
    df = customers(spark, d)
    got, layout = text.open_files(spark, [one_file(spark, joined(df, sep), [sep.join(df.columns)])])
    return got.select(*df.columns, F.lit(layout.delimiter).alias("delimiter"), F.col("_ok").alias("ok"))


def open_csv(spark, d):
    return opened(spark, d, ",")


def open_tsv(spark, d):
    return opened(spark, d, "\t")


def open_pipe(spark, d):
    return opened(spark, d, "|")


def open_semicolon(spark, d):
    return opened(spark, d, ";")


def open_aligned(spark, d):
    df = customers(spark, d)
    line = lambda a, b, c: F.concat(F.rpad(a, 12, " "), F.rpad(b, 26, " "), c)
    lines = df.select(F.col("key").alias("n"), line(F.col("key"), F.col("name"), F.col("nation")).alias("value"))
    got, layout = text.open_files(spark, [one_file(spark, lines, ["key".ljust(12) + "name".ljust(26) + "nation"])])
    return got.select(*df.columns, F.col("_ok").alias("ok"))


def open_json(spark, d):
    df = customers(spark, d)
    got, layout = text.open_files(spark, [one_file(spark, df.select(F.col("key").alias("n"), F.to_json(F.struct(*df.columns)).alias("value")))])
    return got.select(*df.columns, F.lit(layout.delimiter).alias("delimiter"), F.col("_ok").alias("ok"))


def json_mixed(spark, d):
    """Every fifth line is plain text."""
    df = customers(spark, d)
    line = F.when(F.col("key").cast("long") % 5 == 0, F.concat(F.lit("note "), F.col("name"))).otherwise(F.to_json(F.struct(*df.columns)))
    got, _ = text.open_files(spark, [one_file(spark, df.select(F.col("key").alias("n"), line.alias("value")))])
    return got.select(*df.columns, F.col("_ok").alias("ok"), F.when(~F.col("_ok"), F.col("_raw")).alias("raw"))


def json_preamble(spark, d):
    df = customers(spark, d)
    lines = df.select(F.col("key").alias("n"), F.to_json(F.struct(*df.columns)).alias("value"))
    got, layout = text.open_files(spark, [one_file(spark, lines, [f"starting up, step {k}" for k in range(9)])])
    return got.filter("_ok").select(*layout.names)


def json_asked(spark, d):
    """A long preamble, the delimiter given."""
    df = customers(spark, d)
    lines = df.select(F.col("key").alias("n"), F.to_json(F.struct(*df.columns)).alias("value"))
    got, layout = text.open_files(spark, [one_file(spark, lines, [f"starting up, step {k}" for k in range(400)])], "json")
    return got.filter("_ok").select(*layout.names)


def json_document(spark, d):
    """A list of objects, each over several lines."""
    df = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    parts = F.array(F.lit("  {"), F.concat(F.lit('    "key": "'), "key", F.lit('",')), F.concat(F.lit('    "name": "'), "name", F.lit('"')), F.when(F.col("key") == "24", "  }").otherwise("  },"))
    lines = df.select(F.col("key").cast("long").alias("k"), F.posexplode(parts).alias("p", "value")).select((F.col("k") * 4 + F.col("p")).alias("n"), "value")
    lines = lines.unionByName(spark.createDataFrame([(1 << 40, "]")], "n long, value string"))
    got, _ = text.open_files(spark, [one_file(spark, lines, ["["])])
    return got.select("key", "name")


def open_raw(spark, d):
    lines = read(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.concat(F.lit("line"), "c_custkey").alias("value"))
    got, layout = text.open_files(spark, [one_file(spark, lines)])
    return got.select(F.col(layout.names[0]).alias("log"))


def open_pattern(spark, d):
    lines = read(spark, d, "customer").select(F.col("c_custkey").alias("n"), F.when(F.col("c_custkey") % 3 == 0, "none").otherwise(F.concat(F.lit("<"), "c_custkey", F.lit("> "), "c_name")).alias("value"))
    got, _ = text.open_files(spark, [one_file(spark, lines)], r"<(?P<key>\d+)> (?P<name>.*)")
    return got.select("key", "name", F.col("_ok").alias("ok"))


def blank_lines(spark, d):
    df = customers(spark, d)
    lines = joined(df, ",").withColumn("value", F.when(F.col("n") % 4 == 0, "").otherwise(F.col("value")))
    return text.open_files(spark, [one_file(spark, lines, ["key,name,nation"])])[0].select(*df.columns)


def csv_long_cell(spark, d):
    df = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.concat(F.repeat(F.lit('a"b, '), 100_000), "n_name").alias("v"))
    lines = sinks.lines(df, "csv")[1].select(F.col("value").alias("_raw"), F.monotonically_increasing_id().alias(ORDER))
    return text.parse(lines, Layout(",", ("key", "v"), None)).select("key", F.md5("v").alias("v"), F.length("v").cast("long").alias("size"))


def merged_files(spark, d):
    """Two files with the same header; a row of the second that equals it stays."""
    a = read(spark, d, "supplier").select(F.col("s_suppkey").alias("n"), F.concat_ws(",", "s_suppkey", "s_name").alias("value"))
    b = read(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.when(F.col("n_nationkey") == 7, "key,name").otherwise(F.concat_ws(",", "n_nationkey", "n_name")).alias("value"))
    return text.open_merged(spark, [one_file(spark, x, ["key,name"]) for x in (a, b)])[0].select("key", "name")


def merged_unlike(spark, d):
    a = read(spark, d, "region").select(F.col("r_regionkey").alias("n"), F.concat_ws(",", "r_regionkey", "r_name", F.lit("x")).alias("value"))
    b = read(spark, d, "region").select(F.col("r_regionkey").alias("n"), F.concat_ws("\t", "r_regionkey", "r_name", F.lit("y")).alias("value"))
    got, layout = text.open_merged(spark, [one_file(spark, x) for x in (a, b)])
    return got.select("log", F.lit(layout.delimiter).alias("delimiter"))


def folder_of_files(spark, d):
    """A folder as the engine writes it: many files, each with its header."""
    df, folder = customers(spark, d), work_folder(spark)
    sinks.write_folder(df.repartition(5, "key"), folder, "csv")
    return text.open_files(spark, [folder])[0].select(*df.columns)


def written(spark, d, fmt: str) -> DataFrame:
    folder = work_folder(spark)
    sinks.write_folder(customers(spark, d).repartition(3, "key"), folder, fmt)
    return spark.read.text(folder).select(F.col("value").alias("line"))


def sink_json_files(spark, d):
    return written(spark, d, "json")


def sink_raw_files(spark, d):
    return written(spark, d, "raw")


def sink_tsv_files(spark, d):
    """Files with headers, which are read away."""
    return written(spark, d, "tsv").filter(F.col("line") != "key\tname\tnation")


def sink_text(spark, d):
    """What goes to standard output, line by line."""
    out = sinks.to_text(read(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "tsv")
    return spark.createDataFrame([(k, x) for k, x in enumerate(out.split("\r\n")[:-1])], "n long, line string")


def command_source(spark, d):
    """What a command prints of a table's lines."""
    from .streaming.growing import store

    spark.dataSource.register(live.CommandSource)
    command = f"cat {store(event_lines(spark, d))[1]}/part-* | grep click"
    return spark.read.format("command").option("command", command).option("allow", "true").load().select("value")


def switch_delimiter(spark, d):
    """A table of commas read as raw lines: preamble and header are lines again."""
    lines = text.read_lines(spark, one_file(spark, joined(customers(spark, d), ","), ["made by hand", "key,name,nation"]))
    df, _ = text.open_table(lines, ",")
    raw, layout, spec = text.switch(lines, QuerySpec(filters=(Filter("x"),)), "raw")
    return raw.select("log", F.lit(layout.delimiter).alias("delimiter"), F.lit(len(spec.filters)).alias("filters"), F.lit(df.columns[0]).alias("first"))


def excluded_reopened(spark, d):
    """Lines that don't fit are a table with a delimiter of its own."""
    df = customers(spark, d)
    line = F.when(F.col("key").cast("long") % 7 == 3, F.concat_ws("|", "key", "name", "nation", F.lit("x"))).otherwise(F.concat_ws(",", *df.columns))
    got, _ = text.open_files(spark, [one_file(spark, df.select(F.col("key").alias("n"), line.alias("value")), ["key,name,nation"])])
    out, layout = text.open_excluded(got, r"(?P<key>\d+)\|(?P<name>[^|]*)\|(?P<nation>\d+)\|x")
    return out.select("key", "name", "nation", F.lit(text.infer.infer_delimiter([r["_raw"] for r in got.filter("not _ok").orderBy(ORDER).limit(9).collect()])).alias("delimiter"))


def event_lines(spark, d) -> str:
    folder = work_folder(spark)
    read(spark, d, "events").select(F.concat_ws(",", "event_id", "event_type", "user_id").alias("value")).repartition(4, "value").write.text(folder)
    return folder


EVENTS = Layout(",", ("id", "kind", "user"), None)


def stream_append(spark, d):
    """A followed folder: rows that pass a filter are added to files."""
    good, _ = live.table(live.follow(spark, event_lines(spark, d)), EVENTS)
    out = work_folder(spark)
    live.appended(good.drop("_place"), QuerySpec(filters=(Filter("click", "kind"),)), "appended", work_folder(spark), out, availableNow=True).awaitTermination()
    return spark.read.parquet(out).select("id", "kind", "user")


def stream_pivot(spark, d):
    good, _ = live.table(live.follow(spark, event_lines(spark, d)), EVENTS)
    name = f"pivot_{abs(hash(d))}"
    live.start_pivot(good.select("id", "kind", "user", F.col("id").cast("long").alias("_at")), ["kind"], name, work_folder(spark), "_at", availableNow=True).awaitTermination()
    return spark.table(name).select("count", "kind", F.col("id").alias("last_id"), F.col("user").alias("last_user"))


def stream_recompute(spark, d):
    good, _ = live.table(live.follow(spark, event_lines(spark, d), 1), EVENTS)
    shown: list[DataFrame] = []
    spec = QuerySpec(unique=("user",), sort=Sort("user"), columns="user")
    live.recomputed(good, spec, work_folder(spark), work_folder(spark), lambda df, n: shown.append(df), availableNow=True).awaitTermination()
    return shown[-1]


def stream_skips(spark, d):
    """Lines that don't fit are counted, the first of them kept."""
    folder, out = work_folder(spark), work_folder(spark)
    line = F.when(F.col("event_id") % 10 == 0, "broken").otherwise(F.concat_ws(",", "event_id", "event_type", "user_id"))
    read(spark, d, "events").select(line.alias("value")).repartition(3).write.text(folder)
    skips = live.Skips(keep=5)
    live.accounted(live.follow(spark, folder), EVENTS, None, out, work_folder(spark), skips, availableNow=True).awaitTermination()
    kept = spark.read.parquet(f"{out}/*").count()
    return spark.createDataFrame([(skips.rows, skips.skipped, len(skips.samples), kept)], "rows long, skipped long, samples long, kept long")


# log formats: a line of each, with the event's id, kind and user in it

#: Fixed samples: parts of a line, those with a name are cells; $e, $t and $u stand for the event's columns.
LINES: dict[str, list] = {
    "Apache/nginx Common": [("ip", "10.0.0.$u"), " - ", ("user", "u$u"), " [", ("timestamp", "01/Jan/2024:10:00:00 +0000"), '] "', ("method", "GET"), " ", ("path", "/$t"), " ", ("protocol", "HTTP/1.1"), '" ', ("status", "404"), " ", ("size", "$e")],
    "NGINX Error": [("timestamp", "2024/01/01 10:00:00"), " [", ("level", "error"), "] ", ("pid", "$u"), "#", ("tid", "$e"), ": ", ("message", "user $u $t")],
    "AWS CloudWatch/Lambda": [("timestamp", "2024-01-01T10:00:00.123Z"), "\t", ("request_id", "abc-$e"), "\t", ("level", "INFO"), "\t", ("message", "m $t")],
    "Syslog (RFC 3164)": [("timestamp", "Jan  5 10:00:00"), " ", ("host", "host$u"), " ", ("process", "sshd"), "[", ("pid", "$e"), "]: ", ("message", "$t ok")],
    "ISO 8601 + Level + Logger": [("timestamp", "2024-01-01 10:00:00,123"), " ", ("level", "INFO"), "  ", ("logger", "com.app.$t"), " ", ("message", "user $u")],
    "ISO 8601 + Level": [("timestamp", "2024-01-01T10:00:00Z"), " ", ("level", "WARN"), " ", ("message", "low $t $u")],
    "Bracket Timestamp + Level": ["[", ("timestamp", "2024-01-01 10:00:00.5"), "] [", ("level", "info"), "] ", ("message", "hi $u")],
    "Spring Boot / Logback": [("timestamp", "2024-01-15T14:23:01.123+00:00"), "  ", ("level", "INFO"), " ", ("pid", "$e"), " --- [", ("thread", "main"), "] ", ("logger", "c.e.$t"), " : ", ("message", "Started $u")],
    "Go Log": [("timestamp", "2024/01/15 14:23:01"), " ", ("message", "listening $u $t")],
    "Logrus / slog Text": ['time="', ("timestamp", "2024-01-15"), '" level=', ("level", "info"), ' msg="', ("message", "up $t"), '"', ("fields", " port=$u")],
    "Elixir Logger": [("timestamp", "14:23:01.123"), " [", ("level", "info"), "] ", ("message", "started $t")],
    "Ruby/Rails Logger": [("severity_char", "I"), ", [", ("timestamp", "2024-01-15T14:23:01.123456"), " #", ("pid", "$e"), "]  ", ("level", "INFO"), " -- ", ("progname", "app$u"), ": ", ("message", "hello $t")],
    "Laravel / Monolog": ["[", ("timestamp", "2024-01-15 14:23:01"), "] ", ("channel", "local"), ".", ("level", "ERROR"), ": ", ("message", "oops $u")],
    "Rust env_logger": ["[", ("timestamp", "2024-01-15T14:23:01Z"), " ", ("level", "INFO"), "  ", ("target", "app::$t"), "] ", ("message", "ready $u")],
    ".NET Core Logger": [("level", "info"), ": ", ("category", "Microsoft.$t"), "[", ("event_id", "$u"), "]", ("message", " now $e")],
    "Python Logging Default": [("level", "INFO"), ":", ("logger", "root$u"), ":", ("message", "hello $t")],
}
HOLES = {"$e": "event_id", "$t": "event_type", "$u": "user_id"}


def pieces(template: str) -> list[str]:
    import re

    return [x for x in re.split(r"(\$[etu])", template) if x]


def log_query(name: str):
    fmt = next(f for f in logformats.FORMATS if f.name == name)

    def query(spark, d):
        whole = pieces("".join(p if isinstance(p, str) else p[1] for p in LINES[name]))
        line = F.concat(*[F.col(HOLES[x]).cast("string") if x in HOLES else F.lit(x) for x in whole])
        lines = read(spark, d, "events").select(line.alias("_raw"), F.col("event_id").alias(ORDER))
        parsed = text.parse(lines, Layout(fmt.pattern, fmt.columns, None)).filter("_ok")
        return parsed.select(F.col(ORDER).alias("k"), *[f"`{p[0]}`" for p in LINES[name] if not isinstance(p, str)])

    return query


def log_sql(name: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    cells = [" || ".join(f"cast({HOLES[x]} as varchar)" if x in HOLES else quote(x) for x in pieces(p[1])) + f' as "{p[0]}"' for p in LINES[name] if not isinstance(p, str)]
    return f"select event_id as k, {', '.join(cells)} from events"


def slug(name: str) -> str:
    import re

    return "log_" + re.sub(r"\W+", "_", name.lower()).strip("_")


CUSTOMERS = "select cast(c_custkey as varchar) as key, c_name as name, cast(c_nationkey as varchar) as nation"
SQL = {
    "open_csv": f"{CUSTOMERS}, ',' as delimiter, true as ok from customer",
    "open_tsv": f"{CUSTOMERS}, chr(9) as delimiter, true as ok from customer",
    "open_pipe": f"{CUSTOMERS}, '|' as delimiter, true as ok from customer",
    "open_semicolon": f"{CUSTOMERS}, ';' as delimiter, true as ok from customer",
    "open_aligned": f"{CUSTOMERS}, true as ok from customer",
    "open_json": f"{CUSTOMERS}, 'json' as delimiter, true as ok from customer",
    "json_mixed": "select case when c_custkey % 5 = 0 then '' else cast(c_custkey as varchar) end as key, case when c_custkey % 5 = 0 then '' else c_name end as name, case when c_custkey % 5 = 0 then '' else cast(c_nationkey as varchar) end as nation, c_custkey % 5 <> 0 as ok, case when c_custkey % 5 = 0 then 'note ' || c_name end as raw from customer",
    "json_preamble": f"{CUSTOMERS} from customer",
    "json_asked": f"{CUSTOMERS} from customer",
    "json_document": "select cast(n_nationkey as varchar) as key, n_name as name from nation",
    "open_raw": "select 'line' || cast(c_custkey as varchar) as log from customer",
    "open_pattern": "select case when c_custkey % 3 = 0 then '' else cast(c_custkey as varchar) end as key, case when c_custkey % 3 = 0 then '' else c_name end as name, c_custkey % 3 <> 0 as ok from customer",
    "blank_lines": f"{CUSTOMERS} from customer where c_custkey % 4 <> 0",
    "csv_long_cell": "select cast(n_nationkey as varchar) as key, md5(repeat('a\"b, ', 100000) || n_name) as v, cast(length(repeat('a\"b, ', 100000) || n_name) as bigint) as size from nation",
    "merged_files": "select cast(s_suppkey as varchar) as key, s_name as name from supplier union all select case when n_nationkey = 7 then 'key' else cast(n_nationkey as varchar) end, case when n_nationkey = 7 then 'name' else n_name end from nation",
    "merged_unlike": "select cast(r_regionkey as varchar) || ',' || r_name || ',x' as log, 'raw' as delimiter from region union all select cast(r_regionkey as varchar) || chr(9) || r_name || chr(9) || 'y', 'raw' from region",
    "folder_of_files": f"{CUSTOMERS} from customer",
    "sink_json_files": "select '{\"key\":\"' || c_custkey || '\",\"name\":\"' || c_name || '\",\"nation\":\"' || c_nationkey || '\"}' as line from customer",
    "sink_raw_files": "select c_custkey || chr(9) || c_name || chr(9) || c_nationkey as line from customer",
    "sink_tsv_files": "select c_custkey || chr(9) || c_name || chr(9) || c_nationkey as line from customer",
    "sink_text": "select 0::bigint as n, 'r_regionkey' || chr(9) || 'r_name' as line union all select row_number() over (order by r_regionkey), r_regionkey || chr(9) || r_name from region",
    "switch_delimiter": "select log, 'raw' as delimiter, cast(0 as int) as filters, 'key' as first from (select 'made by hand' as log union all select 'key,name,nation' union all select c_custkey || ',' || c_name || ',' || c_nationkey from customer)",
    "excluded_reopened": f"{CUSTOMERS}, '|' as delimiter from customer where c_custkey % 7 = 3",
    "command_source": "select event_id || ',' || event_type || ',' || user_id as value from events where event_type = 'click'",
    "stream_append": "select cast(event_id as varchar) as id, event_type as kind, cast(user_id as varchar) as user from events where event_type = 'click'",
    "stream_pivot": "select count(*) as count, event_type as kind, cast(max(event_id) as varchar) as last_id, cast(arg_max(user_id, event_id) as varchar) as last_user from events group by event_type",
    "stream_recompute": "select distinct cast(user_id as varchar) as user from events",
    "stream_skips": "select count(*) as rows, count(*) filter (event_id % 10 = 0) as skipped, least(5, count(*) filter (event_id % 10 = 0)) as samples, count(*) filter (event_id % 10 <> 0) as kept from events",
} | {slug(n): log_sql(n) for n in LINES}


def queries() -> dict:
    logs = {slug(n): log_query(n) for n in LINES}
    return {name: logs.get(name) or globals()[name] for name in SQL}


