"""Tables as CSV, TSV, JSON lines, plain text, Markdown or HTML."""

from __future__ import annotations

import csv
import html
import io
import json
import sys
from typing import TextIO

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed formats by file extension.
EXTENSIONS = {"json": "json", "jsonl": "json", "tsv": "tsv", "csv": "csv", "txt": "raw", "log": "raw", "md": "markdown", "markdown": "markdown", "html": "html"}


def format_of(path: str) -> str:
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower() if "." in path else "", "csv")


def texts(df: DataFrame) -> DataFrame:
    """Every cell as text, null as empty."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def csv_cell(c: Column, sep: str) -> Column:
    quote = c.rlike('["\r\n' + ("\t" if sep == "\t" else sep) + "]")
    return F.when(quote, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def widths(df: DataFrame) -> dict[str, int]:
    """The widest cell or name of each column, at least 3."""
    row = texts(df).agg(*[F.max(F.length(F.replace(f"`{c}`", F.lit("|"), F.lit("\\|")))).alias(c) for c in df.columns]).first()
    return {c: max(3, len(c), row[c] or 0) for c in df.columns}


def lines(df: DataFrame, fmt: str) -> tuple[list[str], DataFrame, list[str]]:
    """(lines before, a DataFrame with one column value, lines after), in the rows' order."""
    t, names = texts(df), df.columns
    cols = [F.col(f"`{c}`") for c in names]
    if fmt in ("csv", "tsv"):
        sep = "," if fmt == "csv" else "\t"
        head = io.StringIO()
        csv.writer(head, delimiter=sep, lineterminator="").writerow(names)
        return [head.getvalue()], t.select(F.concat_ws(sep, *[csv_cell(c, sep) for c in cols]).alias("value")), []
    if fmt == "json":
        return [], t.select(F.to_json(F.struct(*cols)).alias("value")), []
    if fmt == "markdown":
        w = widths(df)
        escaped = [F.rpad(F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")), w[n], " ") for c, n in zip(cols, names)]
        head = ["| " + " | ".join(n.ljust(w[n]) for n in names) + " |", "| " + " | ".join("-" * w[n] for n in names) + " |"]
        return head, t.select(F.concat(F.lit("| "), F.concat_ws(" | ", *escaped), F.lit(" |")).alias("value")), []
    if fmt == "html":
        safe = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
        head = ["<table>", "<thead><tr>" + "".join(f"<th>{html.escape(n)}</th>" for n in names) + "</tr></thead>", "<tbody>"]
        body = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), safe(c), F.lit("</td>")) for c in cols], F.lit("</tr>"))
        return head, t.select(body.alias("value")), ["</tbody>", "</table>"]
    if fmt == "raw":
        return [], t.select(F.concat_ws("\t", *cols).alias("value")), []
    raise ValueError(f"no format {fmt}")


def write_stream(df: DataFrame, out: TextIO | None = None, fmt: str = "csv") -> int:
    """To an open file or standard output, partition after partition; returns the rows; a closed pipe ends it quietly."""
    out = out or sys.stdout
    before, body, after = lines(df, fmt)
    end, n = ("\r\n" if fmt in ("csv", "tsv") else "\n"), 0
    try:
        for x in before:
            out.write(x + end)
        for row in body.toLocalIterator():
            out.write(row["value"] + end)
            n += 1
        for x in after:
            out.write(x + end)
        out.flush()
    except BrokenPipeError:
        pass
    return n


def write_file(df: DataFrame, path: str, fmt: str | None = None) -> int:
    """One file on the driver; the format from the extension."""
    if path == "-":
        return write_stream(df, None, fmt or "csv")
    with open(path, "w", newline="", encoding="utf-8") as f:
        return write_stream(df, f, fmt or format_of(path))


def write_folder(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A folder of part files, written by the executors; CSV and TSV parts have a header each."""
    if fmt in ("csv", "tsv"):
        texts(df).write.mode("overwrite").option("header", True).option("sep", "," if fmt == "csv" else "\t").option("emptyValue", "").option("escape", '"').csv(path)
    else:
        lines(df, fmt)[1].write.mode("overwrite").text(path)


def to_text(df: DataFrame, fmt: str) -> str:
    out = io.StringIO()
    write_stream(df, out, fmt)
    return out.getvalue()


def json_rows(text: str) -> list[dict]:
    return [json.loads(x) for x in text.splitlines()]
