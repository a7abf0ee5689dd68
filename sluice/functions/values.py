"""Cells as numbers, natural keys, JSON paths and key=value maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed grammar of numbers.
NUMERIC = r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"


def looks_numeric(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(NUMERIC)


def number(c: Column) -> Column:
    """The cell as a double, null if it isn't written as a number."""
    return F.when(looks_numeric(c), c.try_cast("double"))


def natural_key(c: Column) -> Column:
    """Lower-cased runs of text and integers, ordered as such, as one string that sorts by its bytes; the first run is always text."""
    low = F.lower(F.coalesce(c, F.lit("")))
    # a text ends with a mark below whatever may go on; integers of any length go by their number of digits, then by the digits
    ended = F.concat(F.replace(low, F.lit("\0"), F.lit("\0\2")), F.lit("\0\1"))
    runs = F.transform(F.split(low, r"\d+", -1), lambda t: F.concat(F.replace(t, F.lit("\0"), F.lit("\0\2")), F.lit("\0\1")))
    digits = F.transform(F.regexp_extract_all(low, F.lit(r"(\d+)"), F.lit(1)), lambda d: F.regexp_replace(d, r"\A0+(?=\d)", ""))
    counted = F.transform(digits, lambda d: F.concat(F.lpad(F.length(d).cast("string"), 10, "0"), d))
    mixed = F.array_join(F.transform(runs, lambda t, k: F.concat(t, F.coalesce(F.get(counted, k), F.lit("")))), "")
    return F.when(low.rlike(r"\d"), mixed).otherwise(ended)


def split_part(c: Column, delimiter: str, index: int) -> Column:
    """Part index (from 0) of a literal split; empty where there is none."""
    from .regexes import java_literal

    return F.coalesce(F.get(F.split(c, java_literal(delimiter), -1), index), F.lit(""))


def json_path(path: str) -> str:
    """A dotted path with integer list indexes as a JSONPath."""
    out = "$"
    for part in path.split("."):
        out += f"[{part}]" if part.isdigit() else "['" + part.replace("'", "\\'") + "']"
    return out


def json_value(c: Column, path: str) -> Column:
    """What a dotted path leads to, containers as JSON text; empty where it leads nowhere."""
    return F.coalesce(F.get_json_object(c, json_path(path)), F.lit(""))


#: key=value pairs; quoted values first, so that they keep their blanks.
PAIR = r"""([A-Za-z_][\w.\-]*)=("[^"]*"|'[^']*'|[^\s,;]+)"""


def key_values(c: Column) -> Column:
    """The cell's key=value pairs as (k, v), the last one first, quotes stripped."""
    keys = F.regexp_extract_all(c, F.lit(PAIR), F.lit(1))
    values = F.transform(F.regexp_extract_all(c, F.lit(PAIR), F.lit(2)), lambda v: F.regexp_replace(v, r"""\A(["'])(.*)\1\z""", "$2"))
    return F.reverse(F.arrays_zip(keys.alias("k"), values.alias("v")))


def pair_value(pairs: Column, key: str) -> Column:
    """The value of a key among ``key_values``: the last of a repeated key wins; empty where there is none."""
    return F.coalesce(F.get(F.filter(pairs, lambda p: p["k"] == key), 0)["v"], F.lit(""))


def key_value(c: Column, key: str) -> Column:
    return pair_value(key_values(c), key)
