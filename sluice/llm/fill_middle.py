"""Fill-in-middle transformation on ropes (operator 11).

A text becomes a rope: a balanced tree whose leaves hold a few thousand code
points each, cut where a unit ends, and whose nodes cache how many units and code
points stand below them.  The tree is split at two unit ranks, which touches one
leaf and the path to it; the three subtrees are put together again with sentinels
between them.  The inverse splits the output's tree at the code-point ranks of the
sentinels.  A unit is a word with the white space before it, or the white space at
a text's end.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy, whole_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Of 100 texts, how many are rearranged, and how many of those begin with the suffix.
FIM_SHARE, SPM_SHARE = 50, 80
#: Code points of a leaf, at least.
LEAF = 2048

SPACES = " \t\n\v\f\r"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
UNIT_END = re.compile(r"[^\x20\x09-\x0D][\x20\x09-\x0D]")


class Rope:
    """A leaf with its text, or two subtrees; units and chars are those of the whole subtree."""

    __slots__ = ("left", "right", "text", "units", "chars", "height")


def leaf(text: str) -> Rope:
    out = Rope()
    out.left = out.right = None
    out.text, out.chars, out.height = text, len(text), 0
    out.units = len(text.encode().split()) + (text[-1:] != "" and text[-1] in SPACES)
    return out


def node(a: Rope, b: Rope) -> Rope:
    out = Rope()
    out.left, out.right, out.text = a, b, None
    out.units, out.chars, out.height = a.units + b.units, a.chars + b.chars, max(a.height, b.height) + 1
    return out


def build(text: str, size: int = LEAF) -> Rope | None:
    """The rope of a text; None of an empty one."""
    level, at = [], 0
    while at < len(text):
        found = UNIT_END.search(text, at + size - 1) if at + size < len(text) else None
        end = found.start() + 1 if found else len(text)
        level.append(leaf(text[at:end]))
        at = end
    while len(level) > 1:
        level = [node(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else None


def concat(a: Rope | None, b: Rope | None) -> Rope | None:
    """Both in order, heights of siblings a step apart at most where they were before."""
    if a is None or b is None:
        return a or b
    if a.height > b.height + 1:
        inner = concat(a.right, b)
        if inner.height <= a.left.height + 1:
            return node(a.left, inner)
        if inner.left.height > inner.right.height:
            return node(node(a.left, inner.left.left), node(inner.left.right, inner.right))
        return node(node(a.left, inner.left), inner.right)
    if b.height > a.height + 1:
        inner = concat(a, b.left)
        if inner.height <= b.right.height + 1:
            return node(inner, b.right)
        if inner.right.height > inner.left.height:
            return node(node(inner.left, inner.right.left), node(inner.right.right, b.right))
        return node(inner.left, node(inner.right, b.right))
    return node(a, b)


def split(rope: Rope | None, rank: int, by: str = "units") -> tuple[Rope | None, Rope | None]:
    """(the first rank units or chars, the rest)."""
    if rope is None or rank <= 0:
        return None, rope
    if rank >= getattr(rope, by):
        return rope, None
    if rope.left is None:
        at = rank if by == "chars" else next(islice(UNIT.finditer(rope.text), rank - 1, None)).end()
        return leaf(rope.text[:at]), leaf(rope.text[at:])
    before = getattr(rope.left, by)
    if rank <= before:
        a, b = split(rope.left, rank, by)
        return a, concat(b, rope.right)
    a, b = split(rope.right, rank - before, by)
    return concat(rope.left, a), b


def text_of(rope: Rope | None) -> str:
    out, stack = [], [rope] if rope else []
    while stack:
        x = stack.pop()
        if x.left is None:
            out.append(x.text)
        else:
            stack += [x.right, x.left]
    return "".join(out)


def chars(rope: Rope | None) -> int:
    return rope.chars if rope else 0


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """Four 32-bit numbers of a document; a null doc_id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def rearranged(doc_id: int | None, text: str, seed: int = SEED, size: int = LEAF) -> tuple:
    """(units, form, output, code points of the prefix, and of the middle)."""
    rope = build(text, size)
    n = rope.units if rope else 0
    h = draws(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= FIM_SHARE:
        return n, "plain", text, None, None
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    head, suffix = split(rope, high)
    prefix, middle = split(head, low)
    marks = {s: leaf(s) for s in (PREFIX, SUFFIX, MIDDLE)}
    spm = h[3] % 100 < SPM_SHARE
    parts = [(SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)] if spm else [(PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle)]
    out = None
    for mark, part in parts:
        out = concat(concat(out, marks[mark]), part)
    return n, "spm" if spm else "psm", text_of(out), chars(prefix), chars(middle)


def restored(output: str, form: str, size: int = LEAF) -> str:
    """The text that an output of this form was made of."""
    if form == "plain":
        return output
    order = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    # the parts hold no sentinel, and none begins inside another, so each stands once
    at = [output.index(s) for s in order]
    rest, parts = build(output, size), {}
    for mark, begin in zip(order[::-1], at[::-1]):
        rest, part = split(rest, begin, "chars")
        parts[mark] = split(part, len(mark), "chars")[1]
    return text_of(concat(concat(parts[PREFIX], parts[MIDDLE]), parts[SUFFIX]))


def fill_in_middle(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, n, form, output, prefix_chars, middle_chars) of each row of (doc_id, text).

    A null text is an empty one, and stays plain as texts do that hold a sentinel.
    A null doc_id draws as one without digits; rows of one doc_id draw alike, repeated
    rows come out as often as they were.  An empty table gives no rows; texts may be
    of any length; other columns are not looked at.
    """

    def rows(batches):
        for batch in batches:
            out = [rearranged(d, t.as_py(), seed) for d, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n", "form", "output", "prefix_chars", "middle_chars"])

    made = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    return made.mapInArrow(tidy(rows), "doc_id long, n long, form string, output string, prefix_chars long, middle_chars long")


def restore(made: DataFrame) -> DataFrame:
    """The rows of ``fill_in_middle`` with text, rebuilt from output and form alone."""

    def rows(batches):
        for batch in batches:
            texts = [restored(o.as_py(), f.as_py()) for o, f in zip(batch.column("output"), batch.column("form"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return made.mapInArrow(tidy(rows), f"{kinds}, text string")


_UNITS = r"regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"
#: DuckDB SQL for what the query returns.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, {_UNITS} AS units, [('0x' || h[8 * k + 1 : 8 * k + 8])::BIGINT for k in [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT *, len(units) AS n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS low, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS high,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h[3] % 100 >= {FIM_SHARE} THEN 'plain'
    WHEN h[4] % 100 < {SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:low], '') AS p, array_to_string(units[low + 1:high], '') AS m, array_to_string(units[high + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""
