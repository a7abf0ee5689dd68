"""Text sources: lines with their order, and lines as cells."""

from __future__ import annotations

import os
import subprocess
import sys
from functools import reduce
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.regexes import groups_at_start, java_literal, matches_at_start
from ..operators.rows import ARRIVAL, ORDER, SOURCE, work_folder
from ..plans import infer
from ..plans.infer import Layout
from ..plans.samples import of_files
from ..plans.spec import QuerySpec
from . import documents

#: Lines looked at before a source is split.
SAMPLE = 20
#: Bits of a line's order that are its place in the file; those above are the file's number.
PLACE_BITS = 41


def plain(path: str) -> str:
    return os.path.expanduser(path) if path.startswith("~") else path


def files_of(spark: SparkSession, *paths: str) -> list[str]:
    """The files of paths, folders and globs: paths in the given order, the files of each by name.

    All paths are listed together; those that are no file are listed again alone.
    """
    if not paths:
        return []
    if len(paths) == 1:
        return sorted(spark.read.text(plain(paths[0])).inputFiles())
    known = {unquote(urlparse(f).path): f for f in spark.read.text([plain(p) for p in paths]).inputFiles()}
    out: list[str] = []
    for path in paths:
        file = known.get(os.path.abspath(unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else plain(path)))
        out += [file] if file else sorted(spark.read.text(plain(path)).inputFiles())
    return out


def as_path(file: str) -> str:
    """A listed file in the way that a scan names it."""
    return file.replace(":///", ":/", 1)


def base_name(file: str) -> str:
    return unquote(file).rpartition("/")[2]


def scans(files: list[str]) -> list[list[tuple[int, str]]]:
    """The (number, file) pairs to be read at once: one scan, unless a file was named several times."""
    out: list[list[tuple[int, str]]] = []
    times: dict[str, int] = {}
    for k, f in enumerate(files):
        n = times[f] = times.get(f, -1) + 1
        if n == len(out):
            out.append([])
        out[n].append((k, f))
    return out


def lines_of_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """_raw, _ord, _arrival, _source and _file of every line, _start of its split and whether there is _more of the file behind; one scan of all files.

    _ord is the file's number and the line's place: where its split begins, and its row
    in the task.  A split that another of the same file follows is as large as splits
    may be, so it is alone in its task, and its rows are fewer than its bytes.
    """
    place = F.col("_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))

    def one(pairs: list[tuple[int, str]]) -> DataFrame:
        some = [f for _, f in pairs]
        # the place is taken from the scan itself, before rows meet anything else
        read = spark.read.text([unquote(f) for f in some]).select(F.col("value").alias("_raw"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), (F.col("_metadata.file_block_start") + F.col("_metadata.file_block_length") < F.col("_metadata.file_size")).alias("_more"))
        read = read.withColumn("_place", place)
        if len(pairs) == 1:
            k, f = pairs[0]
            read = read.withColumn("_file", F.lit(k).cast("long")).withColumn(SOURCE, F.lit(base_name(f)))
        else:  # as long as the list of files that the driver plans the scan with
            index = spark.createDataFrame([(as_path(f), k, base_name(f)) for k, f in pairs], f"_path string, _file long, {SOURCE} string")
            read = read.join(F.broadcast(index), "_path")
        return read.select("_raw", (F.shiftleft("_file", PLACE_BITS) + F.col("_place")).alias(ORDER), F.current_timestamp().alias(ARRIVAL), SOURCE, "_file", "_start", "_more")

    return reduce(DataFrame.unionByName, [one(pairs) for pairs in scans(files)])


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """_raw, _ord, _arrival and _source of every line; _ord is a number that rises by file and place."""
    files = files_of(spark, *paths)
    return lines_of_files(spark, files).drop("_file", "_start", "_more") if files else lines_of(spark, [])


def heads(spark: SparkSession, files: list[str], n: int) -> DataFrame:
    """_file, _nth (from 0), _ord and _raw of the first n lines of each file that aren't blank, in one job, saved.

    A task whose split another of the same file follows has no other and ends after n
    lines, so of large files only beginnings are read; smaller files, of which a task
    has several, are gone through.
    """

    def first(batches):
        file, seen = None, 0
        for batch in batches:
            ids, starts, more = (batch.column(c).to_pylist() for c in ("_file", "_start", "_more"))
            kept, nth = [], []
            for k, f in enumerate(ids):
                if f != file:
                    file, seen = f, 0
                if starts[k] == 0 and seen < n:
                    kept.append(k)
                    nth.append(seen)
                    seen += 1
            if kept:
                part = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([part.column("_file"), pa.array(nth, pa.int64()), part.column(ORDER), part.column("_raw")], names=["_file", "_nth", ORDER, "_raw"])
            if ids and more[-1] and (starts[-1] or seen >= n):
                return

    folder = work_folder(spark)
    rows = lines_of_files(spark, files).filter("_raw != ''").select("_file", "_start", "_more", ORDER, "_raw")
    rows.mapInArrow(first, f"_file long, _nth long, {ORDER} long, _raw string").write.parquet(folder)
    return spark.read.schema(f"_file long, _nth long, {ORDER} long, _raw string").parquet(folder)


def lines_of(spark: SparkSession, lines: list[str], source: str = "-") -> DataFrame:
    """Lines that the driver holds: standard input, or what a command printed."""
    rows = [(x.rstrip("\r\n"), k) for k, x in enumerate(lines)]
    return spark.createDataFrame(rows, f"_raw string, {ORDER} long").withColumn(ARRIVAL, F.current_timestamp()).withColumn(SOURCE, F.lit(source))


def read_command(spark: SparkSession, command: str, allow: bool = False) -> DataFrame:
    """What a shell command prints; only with allow, since it runs on the driver."""
    if not allow:
        raise PermissionError("commands run only with allow=True")
    out = subprocess.run(["sh", "-c", command], capture_output=True, text=True, errors="ignore", check=False)
    return lines_of(spark, out.stdout.splitlines(), command)


def read_stdin(spark: SparkSession) -> DataFrame:
    return lines_of(spark, sys.stdin.read().splitlines())


def first_lines(df: DataFrame, n: int = SAMPLE) -> list[tuple]:
    """(place, line) of the first lines of a table of lines; of files ``head`` reads no more than it needs."""
    return [(r[ORDER], r["_raw"]) for r in df.orderBy(ORDER).limit(n).select(ORDER, "_raw").collect()]


def csv_cells(v: Column) -> Column:
    """Cells of a comma-separated line, quotes taken off and doubled ones made single."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), v), F.lit(r',("[^"]*+(?:""[^"]*+)*+"|[^,]*+)'), F.lit(1))
    quoted = F.transform(raw, lambda x: F.when(x.startswith('"') & x.endswith('"') & (F.length(x) > 1), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(v.contains('"'), quoted).otherwise(F.split(v, ",", -1))


def cells(v: Column, layout: Layout) -> Column:
    """The line as an array of cells, before they are stripped."""
    d = layout.delimiter
    if layout.offsets:
        ends = [*layout.offsets[1:], None]
        return F.array(*[v.substr(F.lit(a + 1), F.lit(b - a) if b else F.length(v)) for a, b in zip(layout.offsets, ends)])
    if d == " ":
        return F.split(F.regexp_replace(v, r"\A\s+" if layout.most else r"\A\s+|\s+\z", ""), r"\s+", layout.most or -1)
    if d == "  ":
        return F.filter(F.split(v, " {2,}", layout.most or -1), lambda x: x != "")
    if d == ",":
        return csv_cells(v)
    return F.split(v, java_literal(d), -1)


def clean(c: Column) -> Column:
    return F.trim(F.replace(c, F.lit("\t"), F.lit("  ")))


def parse(df: DataFrame, layout: Layout) -> DataFrame:
    """Columns of the layout, and _ok: whether the line has as many cells as there are columns.

    Missing cells are empty, surplus ones are left out.  JSON goes by key, not by
    place, null as empty; a pattern's groups are empty where it doesn't match.
    """
    v, names = F.col("_raw"), layout.names
    meta = [c for c in (ORDER, ARRIVAL, SOURCE, "_raw") if c in df.columns]
    if layout.delimiter == "raw":
        made, ok = {"log": v}, F.lit(True)
    elif layout.delimiter == "json":
        obj = F.from_json(F.regexp_replace(v, r",\s*\z", ""), "map<string,string>")
        df = df.withColumn("_j", obj)
        made = {n: F.coalesce(F.try_element_at("_j", F.lit(n)), F.lit("")) for n in names}
        ok = F.col("_j").isNotNull()
    elif infer.is_pattern(layout.delimiter):
        made, ok = groups_at_start(v, layout.delimiter), matches_at_start(v, layout.delimiter)
    else:
        df = df.withColumn("_c", cells(v, layout))
        made = {n: clean(F.coalesce(F.get("_c", k), F.lit(""))) for k, n in enumerate(names)}
        ok = F.size("_c") == len(names)
    return df.select(*[c.alias(n) for n, c in made.items()], *meta, ok.alias("_ok"))


def split_ok(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, lines that don't)."""
    return df.filter("_ok").drop("_ok", "_raw"), df.filter("not _ok").select("_raw", ORDER)


def elements(texts: DataFrame) -> DataFrame:
    """JSON documents (text, and the place of each as k) as JSON lines: a row for each element of a list, else one."""
    element = F.from_json("text", "array<string>")
    rows = texts.select("k", SOURCE, F.posexplode(F.when(F.ltrim("text").startswith("["), element).otherwise(F.array("text"))).alias("at", "_raw"))
    return rows.select(F.regexp_replace("_raw", r"\s*\n\s*", " ").alias("_raw"), (F.col("k") + F.col("at")).alias(ORDER), F.current_timestamp().alias(ARRIVAL), SOURCE)


def json_document(df: DataFrame) -> DataFrame:
    """Lines that together are one JSON document, as JSON lines.

    The lines are put together in one task, as a document can't be read in parts;
    of files ``json_documents`` reads each in a task of its own.
    """
    whole = df.agg(F.array_sort(F.collect_list(F.struct(ORDER, "_raw"))).alias("x"))
    return elements(whole.select(F.lit(0).cast("long").alias("k"), F.lit("").alias(SOURCE), F.concat_ws("\n", "x._raw").alias("text")))


def json_documents(spark: SparkSession, files: list[str]) -> DataFrame:
    """Files that are a JSON document each, as JSON lines in the order of the files; large ones are read in blocks.

    Only on a file system that pyarrow can't open is each file read whole, in one row.
    """
    index = spark.createDataFrame([(k, as_path(f), base_name(f)) for k, f in enumerate(files)], f"k long, _path string, {SOURCE} string")
    if documents.opens(files[0]):
        found = documents.elements(spark, files).join(F.broadcast(index), "k")
        text = F.regexp_replace("text", r"\s*\n\s*", " ")
        return found.select(text.alias("_raw"), (F.shiftleft("k", PLACE_BITS) + F.col("at")).alias(ORDER), F.current_timestamp().alias(ARRIVAL), SOURCE)

    def one(pairs: list[tuple[int, str]]) -> DataFrame:
        texts = spark.read.text([unquote(f) for _, f in pairs], wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("_path"))
        return texts.join(F.broadcast(index.filter(F.col("k").isin([k for k, _ in pairs]))), "_path").select(F.shiftleft("k", PLACE_BITS).alias("k"), SOURCE, "text")

    return elements(reduce(DataFrame.unionByName, [one(pairs) for pairs in scans(files)]))


def is_object(line: str) -> bool:
    return isinstance(infer.loads(line.strip().rstrip(",")), dict)


def first_object(df: DataFrame) -> tuple | None:
    """(place, line) of the first line that is a JSON object; each task ends at the first that it finds."""
    found = df.filter(F.ltrim("_raw").startswith("{") & F.from_json(F.regexp_replace("_raw", r",\s*\z", ""), "map<string,string>").isNotNull()).select(ORDER, "_raw")

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                # rows come in the order of places, but for files that share a task
                k = min(range(batch.num_rows), key=batch.column(0).to_pylist().__getitem__)
                yield batch.slice(k, 1)
                return

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    row = found.mapInArrow(first, kinds).orderBy(ORDER).first()
    return (row[ORDER], row["_raw"]) if row else None


def json_lines(df: DataFrame, found: list[tuple], asked: bool, files: list[str] = ()) -> tuple[DataFrame, list[tuple]] | None:
    """(lines as JSON, a sample of those that are objects); None if they aren't JSON.

    Lines are JSON if half of the sample or more are objects; what stands before and
    between them will not fit and is there to be looked at.  A sample that begins
    like JSON without such lines is a document.  asked: the user said so; then the
    first object may come later, and lines without an object are one document.
    """
    rows = [(k, x) for k, x in found if x.strip() not in ("[", "]", "[]")]
    objects = [(k, x) for k, x in rows if is_object(x)]
    if not objects and asked and (later := first_object(df)):
        return df, [later]
    if objects and (asked or 2 * len(objects) >= len(rows)):
        return df, objects
    if rows and (asked or infer.is_json_start([x for _, x in found])):
        document = json_documents(df.sparkSession, files) if files else json_document(df)
        sample = first_lines(document)
        return (document, sample) if sample and is_object(sample[0][1]) else None
    return None


def open_table(
    df: DataFrame, delimiter: str | None = None, detect_logs: bool = False, sample: list[tuple] | None = None, repeated: DataFrame | None = None, custom: tuple = (), files: tuple = ()
) -> tuple[DataFrame, Layout]:
    """Lines as a table: layout from the first lines, header and preamble left out, blank lines dropped.

    sample: (place, line) of the first lines, if the caller has them.  repeated: the
    places (_ord, _raw) of the first lines of files; one that equals the header is dropped.  custom: log formats that are tried before the known ones.
    files: the files that the lines are from, if they may be JSON documents.
    An inferred layout that doesn't fit is changed by ``relayout``.  Lines that
    don't fit the layout come with _ok false.
    """
    found = [(k, x) for k, x in (sample if sample is not None else first_lines(df.filter("_raw != ''"), LOOKED_AT)) if x != ""]
    rest, found = found, found[:SAMPLE]
    lines = [x for _, x in found]
    asked = delimiter is not None and infer.parse_delimiter(delimiter) == "json"
    if delimiter is None or asked:
        as_json = json_lines(df, found, asked, list(files))
        if as_json:
            df, objects = as_json
            layout = infer.infer_layout([x for _, x in objects], "json")
            return parse(df.filter((F.col("_raw") != "") & ~F.trim("_raw").isin("[", "]", "[]")), layout), layout
    if delimiter is None and detect_logs:
        from ..plans.logformats import choose

        fmt = choose(lines, custom)
        if fmt and infer.infer_delimiter(lines) in ("raw", "  ", ","):
            delimiter = fmt.pattern
    layout = infer.infer_layout(lines, delimiter)
    if delimiter is None:
        layout, found = relayout(layout, found, rest)
    rows = df.filter("_raw != ''")
    if layout.header is not None and found:
        head_order, first = found[layout.header]
        rows = rows.filter(F.col(ORDER) > F.lit(head_order))
        if repeated is not None:  # one line a file, as many as the scan's files, which the driver lists
            rows = rows.join(F.broadcast(repeated.filter(F.col("_raw") == first).select(ORDER)), ORDER, "left_anti")
    return parse(rows, layout), layout


#: Lines that say whether an inferred layout fits.
LOOKED_AT = 200


def relayout(layout: Layout, found: list[tuple], rest: list[tuple], share: float = 0.3, least: int = 3) -> tuple[Layout, list[tuple]]:
    """(layout, the sample that its header is in): where 3 lines and more than 0.3 of all looked at don't fit, one from the largest group of lines with as many words."""
    if layout.delimiter in ("raw", "json") or infer.is_pattern(layout.delimiter) or layout.header is None:
        return layout, found
    n = len(layout.names)
    fits = lambda x: bool(layout.offsets) or len(infer.fields(x, layout.delimiter, layout.most)) == n
    body = rest[layout.header + 1 :]
    bad = [(k, x) for k, x in body if x.strip() and not fits(x)]
    if len(bad) < least or len(bad) <= share * len(body):
        return layout, found
    usual, _ = infer.commonest([len(x.split()) for _, x in bad])
    major = [(k, x) for k, x in bad if len(x.split()) == usual]
    new = infer.infer_layout([x for _, x in major])
    return (layout, found) if new.delimiter in ("raw", layout.delimiter) else (new, major)


def open_files(spark: SparkSession, paths: list[str], delimiter: str | None = None, detect_logs: bool = False, custom: tuple = (), found: DataFrame | None = None) -> tuple[DataFrame, Layout]:
    """Paths, folders or globs as a table; each file may repeat the header.  found: ``heads`` of the files, if the caller has them."""
    files = files_of(spark, *paths)
    if not files:
        return open_table(lines_of(spark, []), delimiter, detect_logs, [], custom=custom)
    found = heads(spark, files, LOOKED_AT) if found is None else found
    sample = [(r[ORDER], r["_raw"]) for r in found.orderBy(ORDER).limit(LOOKED_AT).select(ORDER, "_raw").collect()]
    starts = found.filter("_nth = 0") if len(files) > 1 else None
    lines = lines_of_files(spark, files).drop("_file", "_start", "_more")
    return open_table(lines, delimiter, detect_logs, sample, starts, custom, tuple(files))


def switch(lines: DataFrame, spec: QuerySpec, delimiter: str) -> tuple[DataFrame, Layout, QuerySpec]:
    """The same lines by another delimiter: all of them count again, a former header and preamble too, and the query starts anew."""
    df, layout = open_table(lines, delimiter)
    return df, layout, spec.with_delimiter(delimiter)


def open_excluded(df: DataFrame, delimiter: str | None = None) -> tuple[DataFrame, Layout]:
    """The lines that didn't fit a table's layout, as a table by a layout of their own."""
    return open_table(split_ok(df)[1], delimiter)


#: Lines of each file that say how it is delimited.
OF_EACH = 15


def open_merged(spark: SparkSession, paths: list[str], delimiter: str | None = None) -> tuple[DataFrame, Layout]:
    """Several files as one table with _source; raw if they aren't delimited alike."""
    files, found = files_of(spark, *paths), None
    if delimiter is None and files:
        found = heads(spark, files, LOOKED_AT)
        kinds = of_files(found.filter(F.col("_nth") < OF_EACH)).select("delimiter").distinct().limit(2).collect()
        delimiter = kinds[0][0] if len(kinds) == 1 else "raw"
    return open_files(spark, paths, delimiter, found=found)
