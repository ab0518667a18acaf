"""Regular expressions: Python's in Java's engine, escaping, and matching of columns."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are not escaped in inferred expressions (fixed values).
PLAIN = frozenset("!\"%',/:;<=>@_` ")


def escape(text: str) -> str:
    return "".join(c if c.isalnum() or c in PLAIN or ord(c) > 127 else "\\" + c for c in text)


def bracket(chars: Sequence[str]) -> str:
    """A character class of single characters: a closing bracket first, a caret not first, a hyphen last."""
    rest = [c for c in chars if c not in "]^-\\"]
    out = ("]" if "]" in chars else "") + "".join(rest) + ("\\\\" if "\\" in chars else "")
    return "[" + (out + ("^" if "^" in chars else "") if out else "\\^" if "^" in chars else "") + ("-" if "-" in chars else "") + "]"


def to_java(pattern: str) -> str:
    """A pattern with which Java's find does what Python's ``re.match`` does with Unicode and dot-all flags.

    Raises ValueError for what has no counterpart: named groups of Python's form, and conditional groups.
    """
    re.compile(pattern)
    if re.search(r"\(\?P[<=>]|\(\?\(", pattern):
        raise ValueError(f"no counterpart in Java: {pattern}")
    out, i, inside, first = [], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append("\\z" if pattern[i + 1] == "Z" and not inside else pattern[i : i + 2])
            i += 2
            continue
        if inside:
            if c == "]" and i > first:
                inside = False
                out.append(c)
            elif c in "[&" or c == "]":
                out.append("\\" + c)
            else:
                out.append(c)
        elif c == "[":
            inside, first = True, i + 1
            out.append(c)
            if pattern[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
                first += 1
        else:
            out.append(c)
        i += 1
    return rf"(?Usd)\A(?:{''.join(out)})"


def unnamed(pattern: str) -> str:
    """``pattern`` with named groups as numbered ones, which match the same; left as it is where a number would be wrong."""
    places = re.compile(pattern).groupindex
    if not places:
        return pattern
    out = re.sub(r"(\\.)|\(\?P=(\w+)\)", lambda m: m[1] or f"(?:\\{places[m[2]]})", re.sub(r"(\\.)|\(\?P<\w+>", lambda m: m[1] or "(", pattern, flags=re.DOTALL), flags=re.DOTALL)
    try:  # in a bracket the same characters aren't a group
        return out if re.compile(out).groups == re.compile(pattern).groups and not re.search(r"\[[^\]]*\(\?P", pattern) else pattern
    except re.error:
        return pattern


def matches(c: Column, pattern: str) -> Column:
    """Whether a text column matches from its start, as ``re.match``; by Python itself where Java can't."""
    try:
        return c.rlike(to_java(unnamed(pattern)))
    except ValueError:
        return _by_python(pattern)(c)


def _by_python(pattern: str):
    import pyarrow as pa

    def match(values: pa.Array) -> pa.Array:
        test = re.compile(pattern, re.UNICODE | re.DOTALL).match
        return pa.array([None if v is None else test(v) is not None for v in values.to_pylist()], pa.bool_())

    match.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(match, "boolean")


def matches_any(c: Column, patterns: Sequence[str]) -> Column:
    """Null for null, else whether one of the patterns matches; no pattern matches nothing."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | matches(c, p)
    return F.when(c.isNotNull(), hit)
