"""Dates in text: parsing single values, and inference of a column's format."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import col

_DATE = re.compile(r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T](\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?)?")


def parse_date(text):
    """A date with or without time, ``-`` or ``/`` between its parts, as a datetime; anything else unchanged.

    Digits of a fraction are decimals of a second, so that ``.5`` is half a second.
    """
    m = _DATE.fullmatch(text) if isinstance(text, str) else None
    if not m:
        return text
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    micro = int((m[7] or "0").ljust(6, "0")[:6])
    try:
        return datetime.datetime(year, month, day, hour, minute, second, micro)
    except ValueError:
        return text


_FORM = re.compile(r"^(\d{1,4})([-/. ])(\d{1,2})([-/. ])(\d{1,4})(?:([T ])(\d{1,2}):(\d{2})(?::(\d{2})(\.\d+)?)?)?$")


def _questions(v: Column) -> dict[str, Column]:
    """Aggregates over a text column from which its date format follows."""
    form = _FORM.pattern
    part = lambda i: F.regexp_extract(v, form, i)
    number = lambda i: F.try_to_number(F.when(part(i) != "", F.lpad(part(i), 4, "0")), F.lit("9999")).cast("int")
    own = lambda i: F.when(v.isNotNull(), part(i))
    return {
        "n": F.count(v), "dates": F.count_if(v.rlike(form)), "a": F.max(number(1)), "b": F.max(number(3)),
        "first": F.min(F.length(own(1))), "first_most": F.max(F.length(own(1))), "last": F.min(F.length(own(5))), "last_most": F.max(F.length(own(5))),
        "s1": F.min(own(2)), "s2": F.max(own(2)), "s3": F.min(own(4)), "s4": F.max(own(4)), "t1": F.min(own(6)), "t2": F.max(own(6)),
        "seconds": F.count_if(own(9) != ""), "fractions": F.count_if(own(10) != ""),
    }


def _format_from(got: dict) -> str | None:
    if not got["n"] or got["dates"] < got["n"] or not got["s1"] == got["s2"] == got["s3"] == got["s4"] or got["t1"] != got["t2"]:
        return None
    s = got["s1"]
    if got["first"] == 4:
        date = f"yyyy{s}M{s}d"
    elif got["first_most"] <= 2 and got["last"] == got["last_most"] and got["last"] in (2, 4):
        year = "y" * got["last"]
        if got["a"] > 12 and got["b"] <= 12:
            date = f"d{s}M{s}{year}"
        elif got["b"] > 12 and got["a"] <= 12:
            date = f"M{s}d{s}{year}"
        else:
            return None
    else:
        return None
    if not got["t1"]:
        return date
    if got["seconds"] not in (0, got["n"]):
        return None
    time = "H:mm" + (":ss" if got["seconds"] else "") + ("[.SSSSSSSSS][.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]" if got["fractions"] else "")
    return f"{date}'{got['t1']}'{time}" if got["t1"] == "T" else f"{date} {time}"


def infer_date_formats(df: DataFrame, names: Sequence[str], sample: int | None = None) -> dict[str, str | None]:
    """Spark datetime pattern of each text column, or None for one that isn't of dates throughout, or is ambiguous.

    ISO order is known by its four-digit year in front. Otherwise day and month are told apart by a value over 12 in
    either place; all rows count unless ``sample`` limits them. One aggregate answers all questions for all columns.
    """
    if not names:
        return {}
    rows = df.select(*(F.trim(col(n)).alias(f"v{i}") for i, n in enumerate(names)))
    if sample:
        rows = rows.limit(sample)
    asked = {(n, k): c for i, n in enumerate(names) for k, c in _questions(F.col(f"v{i}")).items()}
    row = rows.agg(*(c.alias(f"q{i}") for i, c in enumerate(asked.values()))).first()
    answers: dict[str, dict] = {n: {} for n in names}
    for i, (n, k) in enumerate(asked):
        answers[n][k] = row[f"q{i}"]
    return {n: _format_from(a) for n, a in answers.items()}


def infer_date_format(df: DataFrame, name: str, sample: int | None = None) -> str | None:
    """The pattern of one column, of its rows that aren't null."""
    return infer_date_formats(df.filter(col(name).isNotNull()) if sample else df, [name], sample)[name]


def parsed(c: Column, pattern: str) -> Column:
    return F.try_to_timestamp(c, F.lit(pattern))


def convert_dates(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``df`` with text columns that hold dates throughout as timestamps; a column with any failure stays as it is.

    One aggregate finds the patterns of all columns, and one tests them.
    """
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and (names is None or f.name in names)]
    new = {n: (p, parsed(F.trim(col(n)), p)) for n, p in infer_date_formats(df, texts).items() if p}
    if not new:
        return df
    lost = df.agg(*(F.count_if(col(n).isNotNull() & c.isNull()).alias(f"l{i}") for i, (n, (_, c)) in enumerate(new.items()))).first()
    return df.withColumns({n: c if "H" in p else c.cast("date") for i, (n, (p, c)) in enumerate(new.items()) if not lost[f"l{i}"]} or {})
