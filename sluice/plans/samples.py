"""What the first lines of many sources say, decided in the tasks that hold them: one row a source."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame

from ..functions import datetimes, values
from . import infer, logformats

COLUMNS = "_file long, delimiter string, header long, names array<string>, format string, types array<string>, splits array<string>"


def cells_of(lines: list[str], layout: infer.Layout) -> list[list[str]]:
    """The sample's cells by column, below the header; those of other layouts than delimited ones aren't split."""
    if layout.header is None:
        return [[] for _ in layout.names]
    rows = [infer.by_offsets(x, list(layout.offsets)) if layout.offsets else infer.fields(x, layout.delimiter, layout.most) for x in lines[layout.header + 1 :] if x.strip()]
    rows = [r for r in rows if len(r) == len(layout.names)]
    return [[r[k].strip() for r in rows] for k in range(len(layout.names))]


def described(lines: list[str]) -> dict:
    """Layout, log format, column types and how cells could be split further, of a source's first lines."""
    layout = infer.infer_layout(lines)
    form = logformats.detect(lines)
    columns = cells_of(lines, layout)
    splits = [f"{n}:{infer.cell_suggestions(c[0])[0]}" for n, c in zip(layout.names, columns) if infer.splittable(c) and infer.cell_suggestions(c[0])]
    return {
        "delimiter": layout.delimiter, "header": layout.header, "names": list(layout.names), "format": form.name if form else None,
        "types": [infer.column_type(n, c)[0] for n, c in zip(layout.names, columns)], "splits": splits,
    }


def of_files(found: DataFrame) -> DataFrame:
    """(_file, delimiter, header, names, format, types, splits) of each file, by its ``heads``.

    A group is the first lines of a file, as many as heads were asked for.
    """
    for module in (infer, logformats, datetimes, values):
        cloudpickle.register_pickle_by_value(module)

    def one(key, rows):
        import pandas as pd

        got = described(rows.sort_values("_nth")["_raw"].tolist())
        return pd.DataFrame([{"_file": key[0], **got}]).astype({"header": "Int64"})

    cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["x"]))
    return found.groupBy("_file").applyInPandas(one, COLUMNS)
