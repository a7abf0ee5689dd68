"""User patterns in Python's dialect, made ready for Spark's Java regex engine."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMED = re.compile(r"\(\?P<(\w+)>")
BACK = re.compile(r"\(\?P=(\w+)\)")


@dataclass(frozen=True)
class Pattern:
    """A checked pattern: Java source without group names, and the names by group number."""

    source: str
    java: str
    names: tuple[str, ...]
    ignore_case: bool = True

    @property
    def flagged(self) -> str:
        """With Unicode classes, and Unicode case folding where case is ignored."""
        return ("(?iuU)" if self.ignore_case else "(?U)") + self.java


def translate(source: str, ignore_case: bool = True) -> Pattern:
    """Raises re.error for what Python rejects; unnamed groups are named group_<number>."""
    known = re.compile(source)
    numbers = {n: k for n, k in known.groupindex.items()}
    java = BACK.sub(lambda m: rf"\{numbers[m[1]]}", NAMED.sub("(", source))
    java = java.replace(r"\Z", r"\z")
    by_number = {k: n for n, k in numbers.items()}
    names = tuple(by_number.get(k, f"group_{k}") for k in range(1, known.groups + 1))
    return Pattern(source, java, names, ignore_case)


def contains(column: Column, source: str, ignore_case: bool = True) -> Column:
    """Whether the pattern is found anywhere; null cells count as empty."""
    return F.coalesce(column, F.lit("")).rlike(translate(source, ignore_case).flagged)


def literal(text: str) -> str:
    """A pattern for exactly this text, in both dialects."""
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.A)


def java_literal(text: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}\-])", r"\\\1", text)


def groups_at_start(column: Column, source: str) -> dict[str, Column]:
    """The groups of a match at the very start; empty where it doesn't match."""
    p = translate(source, ignore_case=False)
    at_start = r"\A(?:" + p.java + ")"
    return {name: F.coalesce(F.regexp_extract(column, "(?U)" + at_start, k), F.lit("")) for k, name in enumerate(p.names, 1)}


def matches_at_start(column: Column, source: str) -> Column:
    return column.rlike(r"(?U)\A(?:" + translate(source, ignore_case=False).java + ")")


def replacement(text: str, shift: int = 0) -> str:
    """A Python replacement (\\1, \\g<1>) as a Java one, group numbers moved by shift."""
    out, k = [], 0
    while k < len(text):
        m = re.compile(r"\\(?:g<(\d+)>|(\d{1,2}))").match(text, k)
        if m:
            out.append("${0}".replace("{0}", str(int(m[1] or m[2]) + shift)))
            k = m.end()
        elif text[k] == "\\" and k + 1 < len(text):
            out.append({"n": "\n", "t": "\t"}.get(text[k + 1], "\\" + text[k + 1]))
            k += 2
        else:
            out.append("\\$" if text[k] == "$" else text[k])
            k += 1
    return "".join(out)


def replace_first(column: Column, source: str, by: str, ignore_case: bool = False) -> Column:
    """The first match replaced; a lazy prefix group takes what comes before it."""
    p = translate(source, ignore_case)
    java = re.sub(r"\\([1-9])", lambda m: rf"\{int(m[1]) + 1}", p.java)
    flags = "(?siuU)" if ignore_case else "(?sU)"
    return F.regexp_replace(column, flags + r"\A(.*?)(?-s:" + java + ")", "$1" + replacement(by, 1))


#: Pieces of a pattern: escapes, character classes, groups with a mark, and all else.
PIECES = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\(\?|\(|.", re.S)


def unnamed_groups(source: str) -> int:
    """How many capturing groups have no name."""
    return sum(p == "(" for p in PIECES.findall(source))


def name_groups(source: str, names: list[str]) -> str:
    """The pattern with names given to its unnamed groups, in their order; those beyond the names stay as they are."""
    left = iter(names)

    def named(m: re.Match) -> str:
        name = next(left, None) if m[0] == "(" else None
        return f"(?P<{name}>" if name else m[0]

    return PIECES.sub(named, source)


@dataclass(frozen=True)
class Substitution:
    pattern: str
    by: str
    every_column: bool = False
    ignore_case: bool = False


def parse_substitution(command: str) -> Substitution | None:
    """s/pattern/replacement/[gi] with any separator that is no letter or digit; None if it isn't one."""
    if len(command) < 4 or command[0] != "s" or command[1].isalnum() or command[1] in " \\":
        return None
    sep, parts, now, k = command[1], [], "", 2
    while k < len(command):
        if command[k] == "\\" and k + 1 < len(command):
            now += command[k + 1] if command[k + 1] == sep else command[k : k + 2]
            k += 2
            continue
        if command[k] == sep and len(parts) < 2:
            parts.append(now)
            now = ""
        else:
            now += command[k]
        k += 1
    parts.append(now)
    if len(parts) < 2 or not parts[0]:
        return None
    flags = parts[2].strip() if len(parts) > 2 else ""
    if set(flags) - set("gi"):
        return None
    return Substitution(parts[0], parts[1], "g" in flags, "i" in flags)
