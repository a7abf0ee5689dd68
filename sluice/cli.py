"""The batch command line: python -m sluice [options] [file ...]"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.columns import matching_columns
from .operators.rows import data_columns, tail
from .plans.build import build
from .plans.infer import is_pattern
from .plans.logformats import load_custom
from .plans.spec import QuerySpec, SpecError, Store, parse_filter, parse_format, parse_sort, parse_window
from .sources import sinks, text


@dataclass(frozen=True)
class Call:
    spec: QuerySpec
    files: tuple[str, ...]
    raw: bool
    fmt: str
    merge: bool
    tail: int
    logs: bool
    formats: tuple = ()


def parse_args(argv: list[str]) -> Call:
    p = argparse.ArgumentParser(prog="sluice", description=__doc__)
    p.add_argument("files", nargs="*")
    p.add_argument("-d", "--delimiter")
    p.add_argument("-f", "--filters", action="append", default=[])
    p.add_argument("-x", "--exclude-filters", action="append", default=[])
    p.add_argument("-u", "--unique", action="append", default=[])
    p.add_argument("-s", "--sort-by")
    p.add_argument("-w", "--time-window")
    p.add_argument("-c", "--columns")
    p.add_argument("-F", "--format-timestamp", action="append", default=[])
    p.add_argument("-o", "--output-format", default="csv", choices=["csv", "tsv", "json", "raw", "markdown", "html"])
    p.add_argument("-S", "--session", help="start from a saved query")
    p.add_argument("--sessions", default="~/.sluice/sessions", help="the folder of saved queries")
    p.add_argument("-m", "--merge", action="store_true", help="files as one table with _source; else each is a table of its own")
    p.add_argument("--tail", action="store_true", help="the last rows")
    p.add_argument("--last", type=int, default=10, help="how many rows --tail shows")
    p.add_argument("--raw", action="store_true")
    p.add_argument("--detect-logs", action="store_true")
    p.add_argument("--formats", help="a JSON list of log formats")
    p.add_argument("--no-tui", action="store_true", help="accepted; there is no other mode")
    p.add_argument("--tui", action="store_true", help="not supported")
    a = p.parse_args(argv)
    if a.tui:
        p.error("there is no interactive mode")
    if a.merge and len(a.files) < 2:
        p.error("--merge needs two files or more")
    try:
        spec = Store(os.path.expanduser(a.sessions)).load(a.session) if a.session else QuerySpec()
        given = {
            "delimiter": a.delimiter,
            "filters": (*[parse_filter(x) for x in a.filters], *[parse_filter(x, True) for x in a.exclude_filters]),
            "window": parse_window(a.time_window) if a.time_window else None,
            "unique": tuple(k for u in a.unique for k in u.split(",")),
            "sort": parse_sort(a.sort_by) if a.sort_by else None,
            "formats": tuple(parse_format(x) for x in a.format_timestamp),
            "columns": a.columns,
            "sources": tuple(a.files),
            "tail": a.tail,
        }
        spec = replace(spec, **{k: v for k, v in given.items() if v})
    except SpecError as e:
        p.error(str(e))
    except OSError:
        p.error(f"no session {a.session}")
    return Call(spec, tuple(a.files) or spec.sources, a.raw or a.output_format == "raw", a.output_format, a.merge, a.last if spec.tail else 0, a.detect_logs, load_custom(a.formats) if a.formats else ())


def tables_of(spark: SparkSession, call: Call) -> Iterator[tuple[DataFrame | None, DataFrame]]:
    """(result, lines) of each table: one of standard input or of merged files, else one for each file; no result where lines are passed on as they are."""
    groups = [list(call.files)] if call.merge else [[f] for f in call.files]
    for paths in groups or [None]:
        lines = text.read_lines(spark, *paths) if paths else text.read_stdin(spark)
        if call.raw:
            yield None, lines
            continue
        if paths and len(paths) > 1:
            df, layout = text.open_merged(spark, paths, call.spec.delimiter)
        elif paths:
            df, layout = text.open_files(spark, paths, call.spec.delimiter, call.logs, call.formats)
        else:
            df, layout = text.open_table(lines, call.spec.delimiter, call.logs, custom=call.formats)
        if layout.delimiter == "raw":
            yield None, lines
            continue
        if layout.delimiter == "json" or is_pattern(layout.delimiter):
            df = df.filter("_ok")
        out, skipped = build(replace(call.spec, columns=None), df)
        for s in skipped:
            print(f"skipped: {s}", file=sys.stderr)
        if call.spec.columns:
            names = matching_columns(data_columns(out), call.spec.columns)
            out = out.select(*[f"`{n}`" for n in names])
        yield (out if not call.tail else last_rows(out, call.tail)), lines


def last_rows(df: DataFrame, n: int) -> DataFrame:
    """The last rows of a table in its own order."""
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.orderBy(F.desc("_row")).limit(n).orderBy("_row").drop("_row")


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    call = parse_args(sys.argv[1:] if argv is None else argv)
    own = spark is None
    spark = spark or SparkSession.builder.appName("sluice").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        for df, lines in tables_of(spark, call):
            if df is None:
                lines = tail(lines, call.tail).orderBy("_ord") if call.tail else lines.orderBy("_ord")
                sinks.write_stream(lines.select(F.col("_raw").alias("log")), out, "raw")
            else:
                sinks.write_stream(df, out, call.fmt)
        return 0
    except (SpecError, FileNotFoundError, AnalysisException) as e:
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    sys.exit(main())
