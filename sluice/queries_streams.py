"""Queries over streams and over tables that are kept in order or read in blocks."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.rows import ORDER, work_folder
from .operators.runs import position_index, sorted_table
from .plans.infer import Layout
from .plans.spec import Sort, TimeWindow
from .queries_sources import CUSTOMERS, EVENTS, HOLES, LINES, customers, event_lines, one_file, pieces, read
from .sources import text
from .streaming import growing, keyed, live, pipes
from .streaming.growing import store


def append_lines(lines: DataFrame, folder: str) -> None:
    """Append each task's lines (part, value) to a file of the folder, as programs append to their logs."""
    system, where = store(folder)
    system.create_dir(where)

    def write(batches):
        for batch in batches:
            for part in sorted(set(batch.column(0).to_pylist())):
                mine = [x for p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if p == part]
                with open(f"{where}/log-{part}.txt", "ab") as f:
                    f.write("".join(x + "\n" for x in mine).encode())
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    lines.repartition(3, "part").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def event_text() -> F.Column:
    return F.concat_ws(",", "event_id", "event_type", "user_id")


def stream_tail(spark: SparkSession, d: str) -> DataFrame:
    """Files that grow while the query is down: each line comes once."""
    folder, out, checkpoint = work_folder(spark), work_folder(spark), work_folder(spark)
    events = read(spark, d, "events").select("event_id", (F.col("event_id") % 3).alias("part"), event_text().alias("value"))
    for half in (0, 1):
        append_lines(events.filter(F.col("event_id") % 2 == half).select("part", "value"), folder)
        good, _ = live.table(growing.tail(spark, folder), EVENTS)
        good.drop("_place").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("id", "kind", "user")


def stream_command(spark: SparkSession, d: str) -> DataFrame:
    """What a command prints of a table's lines; run again, it goes on behind what was sealed."""
    lines, log, out, checkpoint = event_lines(spark, d), work_folder(spark), work_folder(spark), work_folder(spark)
    command = f"cat {store(lines)[1]}/part-*"
    with os.popen(f"{command} | wc -l") as p:
        total = int(p.read())
    for wanted in (1, total):
        good, _ = live.table(pipes.follow_command(spark, command, log, allow=True), EVENTS)
        query = good.drop("_place").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()
        while query.isActive and pipes.LineLog(log).last()[1] < wanted:
            query.awaitTermination(0.1)
        query.processAllAvailable()
        query.stop()
    return spark.read.parquet(out).select("id", "kind", "user")


def stream_unique(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each user as it comes, file by file in the order of events."""
    folder, out = work_folder(spark), work_folder(spark)
    events = read(spark, d, "events")
    lines = events.select("event_id", event_text().alias("value")).repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    lines.select("value").write.text(folder)
    good, _ = live.table(live.follow(spark, folder), EVENTS)
    first = keyed.first_per_key(good.select("id", "kind", "user", F.col("id").cast("long").alias("at")), ["user"], "at")
    first.writeStream.format("parquet").option("path", out).option("checkpointLocation", work_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("id", "kind", "user")


def stream_rolling(spark: SparkSession, d: str) -> DataFrame:
    """A rolling window: events of years ago never come in, those without a time stay."""
    folder, changes = work_folder(spark), work_folder(spark)
    time = F.when(F.col("event_id") % 4 == 0, "").otherwise(F.lit("2001-02-03 04:05:06"))
    read(spark, d, "events").select(F.concat_ws(",", "event_id", "event_type", time).alias("value")).write.text(folder)
    good, _ = live.table(live.follow(spark, folder), Layout(",", ("id", "kind", "time"), None))
    window = live.Window(spark, changes, ["id"])
    query = window.start(keyed.rolling(good.select("id", "kind", "time"), TimeWindow(3600, True, "time")), work_folder(spark), 0.2)
    while query.isActive and not window.parts():  # timers keep batches coming; the first one holds all files
        query.awaitTermination(0.2)
    query.stop()
    return window.view().select("id", "kind")


def stream_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Rows that fit and lines that don't, from one reading of each batch; the lines are a table of their own layout."""
    folder = work_folder(spark)
    line = F.when(F.col("event_id") % 5 == 0, F.concat_ws("|", "event_id", "event_type", "user_id", F.lit("odd"))).otherwise(event_text())
    read(spark, d, "events").select(line.alias("value")).repartition(3).write.text(folder)
    split = live.Split(spark, work_folder(spark), EVENTS)
    split.start(live.follow(spark, folder, 1), work_folder(spark), availableNow=True).awaitTermination()
    again, _ = split.reopened(r"(?P<id>\d+)\|(?P<kind>[^|]*)\|(?P<user>\d+)\|odd")
    odd = again.filter("_ok").select("id", "kind", "user", F.lit(False))
    return split.shown().select("id", "kind", "user", F.lit(True).alias("shown")).union(odd)


def stream_sorted(spark: SparkSession, d: str) -> DataFrame:
    """A table kept sorted while batches come; the place of each row in the end."""
    lines = event_lines(spark, d)
    good, _ = live.table(live.follow(spark, lines, 1), EVENTS)
    runs = sorted_table(spark, work_folder(spark), Sort("id", True), "numeric", fan=2)
    live.kept_sorted(good, runs, work_folder(spark), availableNow=True).awaitTermination()
    pages = [runs.page(k, 300).select("id", "kind") for k in (0, 500)]
    return pages[0].withColumn("page", F.lit(0)).union(pages[1].withColumn("page", F.lit(500)))


def page_indexed(spark: SparkSession, d: str) -> DataFrame:
    """A page of rows, and the 11th to 20th row that match, by place."""
    orders = read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias(ORDER), F.col("o_orderkey").cast("long").alias("orderkey"), F.col("o_orderstatus").alias("status"))
    index = position_index(orders, work_folder(spark), file_rows=200)
    where = F.col("status") == "F"
    found = index.page(10, 10, where, index.matches(where, "finished"))
    return index.page(1234, 50).select("orderkey", "status", F.lit("page").alias("of")).union(found.select("orderkey", "status", F.lit("match")))


def json_blocks(spark: SparkSession, d: str) -> DataFrame:
    """One file that is a list of all orders, in blocks of 8 KB; texts with brackets, quotes and backslashes."""
    orders = read(spark, d, "orders")
    hard = F.concat(F.lit('a "[{\\'), F.col("o_orderpriority"), F.lit('\\\\" ],'))
    body = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("key"), hard.alias("text")))
    lines = orders.select(F.col("o_orderkey").alias("n"), F.concat(body, F.lit(",")).alias("value"))
    last = spark.createDataFrame([(1 << 60, '{"key": "-1", "text": ""}]')], "n long, value string")
    folder = one_file(spark, lines.unionByName(last), ["["])
    found = text.documents.elements(spark, text.files_of(spark, folder), 8192)
    return found.select(F.get_json_object("text", "$.key").alias("key"), F.get_json_object("text", "$.text").alias("text"))


def open_many_files(spark: SparkSession, d: str) -> DataFrame:
    """1,500 files, each with the header; lines that equal it later stay, and files are in order."""
    folder = work_folder(spark)
    df = customers(spark, d).withColumn("n", F.col("key").cast("long"))
    numbers = spark.range(1500).select(F.col("id").alias("file"))
    cells = df.select((F.col("n") % 1500).alias("file"), "n", F.concat_ws(",", "key", "name", "nation").alias("value"))
    lines = numbers.select("file", F.lit(-1).cast("long").alias("n"), F.lit("key,name,nation").alias("value")).union(cells)
    lines = lines.union(numbers.filter("file % 100 = 0").select("file", F.lit(1 << 40), F.lit("key,name,nation")))
    files(lines, folder)
    got, _ = text.open_files(spark, [folder])
    return got.select("key", "name", "nation", F.shiftright(F.col(ORDER), text.PLACE_BITS).alias("file"))


def files(lines: DataFrame, folder: str) -> None:
    """Write (file, n, value) as file-00000.txt and so on, in the tasks."""
    system, where = store(folder)
    system.create_dir(where)

    def write(key, rows):
        with open(f"{where}/file-{key[0]:05d}.txt", "w") as f:
            f.write("\n".join(rows.sort_values("n")["value"]) + "\n")
        return rows[["n"]].head(1)

    lines.repartition(8, "file").groupBy("file").applyInPandas(write, "n long").count()


def many_json_documents(spark: SparkSession, d: str) -> DataFrame:
    """1,500 files that are a list of objects each, over several lines."""
    folder = work_folder(spark)
    body = customers(spark, d).withColumn("n", F.col("key").cast("long"))
    item = F.concat(F.lit(' {"key":\n  "'), "key", F.lit('",\n"name": "'), "name", F.lit('"}'))
    lists = body.groupBy((F.col("n") % 1500).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", item.alias("x")))), lambda x: x.x), ","), F.lit("]")).alias("value"))
    files(spark.range(1500).select(F.col("id").alias("file")).join(lists, "file", "left").select("file", F.lit(0).cast("long").alias("n"), F.coalesce("value", F.lit("[]")).alias("value")), folder)
    got, _ = text.open_files(spark, [folder], "json")
    return got.filter("_ok").select("key", "name", F.shiftright(F.col(ORDER), text.PLACE_BITS).alias("file"))


def kinds_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Twelve files of six layouts, half of them with two lines in front of the header."""
    e = read(spark, d, "events").select("event_id", (F.col("event_id") % 12).alias("file"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("user"))
    kind = F.col("file") % 6
    separated = F.concat_ws("#", "id", "kind", "user")
    line = F.when(kind == 4, F.to_json(F.struct("id", "kind", "user"))).when(kind == 5, F.concat(F.lit("only"), "id"))
    for k, sep in enumerate((",", "\t", "|", ";")):
        line = line.when(kind == k, F.translate(separated, "#", sep))
    made = e.select("file", F.col("event_id").alias("n"), line.alias("value"))
    front = spark.range(12).select(F.col("id").alias("file")).filter("file % 6 < 4")
    for k, sep in enumerate((",", "\t", "|", ";")):
        made = made.union(front.filter(F.col("file") % 6 == k).select("file", F.lit(-1).cast("long"), F.lit(sep.join(("id", "kind", "user")))))
        made = made.union(front.filter(F.col("file") == k + 6).select("file", F.explode(F.array(F.lit(-3).cast("long"), F.lit(-2).cast("long"))), F.lit(f"made by{sep}a machine")))
    folder = work_folder(spark)
    files(made, folder)
    return text.heads(spark, text.files_of(spark, folder), 100)


def layouts_of_files(spark: SparkSession, d: str) -> DataFrame:
    """Delimiter, header and names of each file of a folder, inferred where the files are."""
    found = text.of_files(kinds_of_files(spark, d))
    return found.select(F.col("_file").alias("file"), "delimiter", "header", F.array_join("names", ",").alias("names"))


def types_of_files(spark: SparkSession, d: str) -> DataFrame:
    """The types of each file's columns."""
    found = text.of_files(kinds_of_files(spark, d)).filter("header is not null")
    return found.select(F.col("_file").alias("file"), F.array_join("types", ",").alias("types"))


def formats_of_files(spark: SparkSession, d: str) -> DataFrame:
    """The log format of each of a folder's files, whose lines are made of events in turn."""
    names = list(LINES)
    line = None
    for k, name in enumerate(names):
        whole = pieces("".join(p if isinstance(p, str) else p[1] for p in LINES[name]))
        cell = F.concat(*[F.col(HOLES[x]).cast("string") if x in HOLES else F.lit(x) for x in whole])
        line = F.when(F.col("event_id") % len(names) == k, cell) if line is None else line.when(F.col("event_id") % len(names) == k, cell)
    made = read(spark, d, "events").select((F.col("event_id") % len(names)).alias("file"), F.col("event_id").alias("n"), line.alias("value"))
    folder = work_folder(spark)
    files(made, folder)
    found = text.of_files(text.heads(spark, text.files_of(spark, folder), 50))
    return found.select(F.col("_file").alias("file"), "format")


SOME = "select cast(event_id as varchar) as id, event_type as kind"
LAYOUT = "case file % 6 when 0 then ',' when 1 then chr(9) when 2 then '|' when 3 then ';' when 4 then 'json' else 'raw' end as delimiter"
FORMAT = " ".join(f"when {k} then '{n}'" for k, n in enumerate(LINES))
SQL = {
    "layouts_of_files": f"select file, {LAYOUT}, case when file % 6 >= 4 then null when file >= 6 then 2 else 0 end::bigint as header, case when file % 6 = 5 then 'log' else 'id,kind,user' end as names from (select distinct event_id % 12 as file from events)",
    "types_of_files": "select distinct event_id % 12 as file, 'numeric,string,numeric' as types from events where event_id % 6 < 4",
    "formats_of_files": f"select distinct event_id % {len(LINES)} as file, case event_id % {len(LINES)} {FORMAT} end as format from events",
    "stream_tail": f"{SOME}, cast(user_id as varchar) as user from events",
    "stream_command": f"{SOME}, cast(user_id as varchar) as user from events",
    "stream_unique": f"{SOME}, cast(user_id as varchar) as user from events qualify row_number() over (partition by user_id order by event_id) = 1",
    "stream_rolling": f"{SOME} from events where event_id % 4 = 0",
    "stream_excluded": f"{SOME}, cast(user_id as varchar) as user, event_id % 5 <> 0 as shown from events",
    "stream_sorted": f"select id, kind, case when k < 300 then 0 else 500 end as page from ({SOME}, row_number() over (order by event_id desc) - 1 as k from events) where k < 300 or (k >= 500 and k < 800)",
    "page_indexed": "select o_orderkey as orderkey, o_orderstatus as status, 'page' as of from (select *, row_number() over (order by o_orderkey) - 1 as k from orders) where k >= 1234 and k < 1284 union all select o_orderkey, o_orderstatus, 'match' from (select *, row_number() over (order by o_orderkey) - 1 as k from orders where o_orderstatus = 'F') where k >= 10 and k < 20",
    "json_blocks": r"""select cast(o_orderkey as varchar) as key, 'a "[{\' || o_orderpriority || '\\" ],' as text from orders union all select '-1', ''""",
    "open_many_files": f"{CUSTOMERS}, c_custkey % 1500 as file from customer union all select 'key', 'name', 'nation', range from range(0, 1500, 100)",
    "many_json_documents": "select cast(c_custkey as varchar) as key, c_name as name, c_custkey % 1500 as file from customer",
}


def queries() -> dict:
    return {name: globals()[name] for name in SQL}
