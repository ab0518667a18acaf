"""Logical types of columns: bool, int, real, date, string, other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOGICAL = ("bool", "int", "real", "date", "string")


def logical_type(kind: T.DataType) -> str:
    """The logical type of a Spark type; nested, binary and interval types are ``other``, an untyped column is a string."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "real"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, (T.StringType, T.CharType, T.VarcharType, T.NullType)):
        return "string"
    return "other"


def coarse(kind: str | None) -> str | None:
    """``number`` for bool, int and real; other types stand for themselves."""
    return "number" if kind in ("bool", "int", "real") else kind


def col(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def normalised(df: DataFrame) -> DataFrame:
    """``df`` with NaN as null in float columns and untyped columns as strings; other columns untouched."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c), c)
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def field_types(df: DataFrame) -> dict[str, str]:
    return {f.name: logical_type(f.dataType) for f in df.schema.fields}
