"""Tables kept in order as sorted runs, to which batches are added and in which rows are found by their place.

A batch is written as a sorted run of its own, without a look at what is there.  When
a level has FAN runs they are merged into one of the next level, so a row is rewritten
once for each level, and of n batches a batch reads some log n times its own size on
average.  Of each file its rows and its first and last key are kept; from these follows
between which places its rows lie, so row N, a page, or the k-th row that matches is
found in the few files that can hold it.  Manifests say which runs count after which
batch; a batch that comes again after a failure changes nothing.
"""

from __future__ import annotations

import json
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store
from .rows import ORDER, SORT_WAY, Sort, sort_columns

FAN = 4
#: Rows of a file, at most.
FILE_ROWS = 1_000_000


class SortedRuns:
    """A folder of runs, sorted by keys: (column, descending) in turn; the same keys must be given each time it is opened."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[tuple[Column, bool]], fan: int = FAN, file_rows: int = FILE_ROWS):
        self.spark, self.folder, self.keys, self.fan, self.file_rows = spark, folder.rstrip("/"), keys, fan, file_rows
        self.names = [f"_k{k}" for k in range(len(keys))]

    # what there is

    def manifest(self) -> dict:
        """The newest: its batch, its runs, and how many rows merging them has read."""
        found = sorted(store.names(self.spark, f"{self.folder}/_manifest"))
        return json.loads(store.read_text(self.spark, f"{self.folder}/_manifest/{found[-1]}")) if found else {"batch": -1, "runs": [], "read": 0}

    def orders(self, prefix: str = "") -> list[Column]:
        return [SORT_WAY[down](F.col(prefix + n)) for n, (_, down) in zip(self.names, self.keys)]

    def read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*paths)

    def rows(self) -> DataFrame:
        """All rows, in no order."""
        return self.read([r["path"] for r in self.manifest()["runs"]]).drop(*self.names)

    def view(self) -> DataFrame:
        return self.read([r["path"] for r in self.manifest()["runs"]]).orderBy(*self.orders()).drop(*self.names)

    def count(self) -> int:
        return sum(r["rows"] for r in self.manifest()["runs"])

    # adding

    def write(self, df: DataFrame, name: str, level: int) -> dict:
        """A run of rows with their keys, and of each of its files the rows and the first and last key."""
        path = f"{self.folder}/{name}"
        df.repartitionByRange(*self.orders()).sortWithinPartitions(*self.orders()).write.mode("overwrite").option("maxRecordsPerFile", self.file_rows).parquet(path)
        key, at = F.struct(*self.names), F.col("_metadata.row_index")
        files = self.read([path]).select(key.alias("key"), F.col("_metadata.file_path").alias("file"), at.alias("at"))
        files = files.groupBy("file").agg(F.count("*").alias("rows"), F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
        files.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/_files/{name}")
        return {"path": path, "name": name, "level": level, "rows": self.spark.read.parquet(f"{self.folder}/_files/{name}").agg(F.sum("rows")).first()[0] or 0}

    def add(self, df: DataFrame, batch: int) -> int:
        """Add a batch's rows; returns how many rows of earlier batches were read for it."""
        now = self.manifest()
        if batch <= now["batch"]:
            return 0
        new = df.select(*[f"`{c}`" for c in df.columns], *[c.alias(n) for n, (c, _) in zip(self.names, self.keys)])
        runs, read, level = [*now["runs"], self.write(new, f"run-{batch}-0", 0)], 0, 0
        runs = [r for r in runs if r["rows"]] or runs[-1:]
        while len(same := [r for r in runs if r["level"] == level]) >= self.fan:
            merged = self.write(self.read([r["path"] for r in same]), f"run-{batch}-{level + 1}", level + 1)
            read += merged["rows"] - (same[-1]["rows"] if same[-1]["name"] == f"run-{batch}-{level}" else 0)
            runs = [r for r in runs if r not in same] + [merged]
            level += 1
        store.write_text(self.spark, f"{self.folder}/_manifest/{batch:012d}.json", json.dumps({"batch": batch, "runs": runs, "read": now["read"] + read}))
        self.clean()
        return read

    def clean(self) -> None:
        """Delete runs that neither of the newest two manifests names, so that a reader of the last but one can end."""
        found = sorted(store.names(self.spark, f"{self.folder}/_manifest"))
        used = {r["name"] for m in found[-2:] for r in json.loads(store.read_text(self.spark, f"{self.folder}/_manifest/{m}"))["runs"]}
        for m in found[:-2]:
            store.delete(self.spark, f"{self.folder}/_manifest/{m}")
        for name in store.names(self.spark, self.folder):
            if name.startswith("run-") and name not in used:
                store.delete(self.spark, f"{self.folder}/{name}")
                store.delete(self.spark, f"{self.folder}/_files/{name}")

    # finding by place

    def files(self) -> DataFrame:
        """(file, rows, first, last) of every file of every run."""
        return reduce(DataFrame.unionByName, [self.spark.read.parquet(f"{self.folder}/_files/{r['name']}") for r in self.manifest()["runs"]])

    def placed(self, weights: DataFrame | None = None) -> DataFrame:
        """(file, n, low, high): a file's n rows lie among places low to high (excluded), counted by rows or by the given (file, n).

        A row a file; the only window is over these.
        """
        files = self.files().withColumnRenamed("rows", "n")
        if weights is not None:
            files = files.drop("n").join(weights, "file", "left").fillna(0, ["n"])
        ends = files.select("file", "n", F.explode(F.array(*[F.struct(F.lit(k).alias("end"), c.alias("key")) for k, c in enumerate((F.col("first"), F.col("last")))])).alias("e"))
        ends = ends.select("file", "n", "e.end", "e.key.*")
        upto = Window.orderBy(*self.orders(), "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        begun = F.sum(F.when(F.col("end") == 0, F.col("n"))).over(upto)
        ended = F.coalesce(F.sum(F.when(F.col("end") == 1, F.col("n"))).over(upto), F.lit(0))
        # ends of equal key stand behind beginnings, so what ended before is smaller, and what began is no larger
        counted = ends.select("file", "n", "end", begun.alias("begun"), ended.alias("ended"))
        return counted.groupBy("file", "n").agg(F.max(F.when(F.col("end") == 0, F.col("ended"))).alias("low"), F.max(F.when(F.col("end") == 1, F.col("begun"))).alias("high"))

    def span(self, start: int, n: int, weights: DataFrame | None = None) -> tuple[list[str], int]:
        """(the files that can hold the rows start to start + n, rows of files before them)."""
        files = self.placed(weights).filter("n > 0").collect()  # a row a file, as many as a scan of the folder plans with
        return [f["file"] for f in files if f["high"] > start and f["low"] < start + n], sum(f["n"] for f in files if f["high"] <= start)

    def page(self, start: int, n: int, where: Column | None = None, weights: DataFrame | None = None) -> DataFrame:
        """Rows start to start + n in order; of those that pass where, if given with their numbers by file (``matches``)."""
        files, before = self.span(start, n, weights)
        found = self.read([unquote(f) for f in files]) if files else self.read([r["path"] for r in self.manifest()["runs"]][:1]).limit(0)
        found = found.filter(where) if where is not None else found
        return found.orderBy(*self.orders()).offset(start - before).limit(n).drop(*self.names)

    def matches(self, where: Column, name: str) -> DataFrame:
        """(file, n): how many rows of each file pass where, counted in one scan and kept under a name."""
        found = self.read([r["path"] for r in self.manifest()["runs"]]).filter(where).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
        path = f"{self.folder}/_matches/{name}-{self.manifest()['batch']}"
        found.coalesce(1).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def position_index(df: DataFrame, folder: str, order: str = ORDER, file_rows: int = FILE_ROWS) -> SortedRuns:
    """A table that doesn't change, in one run by its order: pages and the k-th match are read from the files that hold them."""
    runs = SortedRuns(df.sparkSession, folder, [(F.col(order), False)], file_rows=file_rows)
    runs.add(df, 0)
    return runs


def sorted_table(spark: SparkSession, folder: str, s: Sort, kind: str, hint: str | None = None, order: str = ORDER, fan: int = FAN) -> SortedRuns:
    """Runs in the order of a query's sort, ties by their own order."""
    return SortedRuns(spark, folder, [*sort_columns(s.column, kind, hint, s.descending), (F.col(order), False)], fan)
