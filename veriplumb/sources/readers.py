"""Tables from files, streams, databases and the catalogue."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import convert_dates
from ..functions.staging import new_place
from ..functions.types import col
from .writers import SEPARATORS

#: Texts that mean null in delimited files (fixed values).
NULLS = ("", "NaN", "NULL")


def quoting(spark: SparkSession, path: str, quote: str = '"', escape: str = "\\") -> tuple[bool, bool]:
    """Whether quoted fields of a file hold line breaks, and whether quotes in them are doubled rather than escaped.

    A line of a field that goes on has an odd number of quotes. One pass over the lines, which no task needs in one piece.
    """
    if not quote:
        return False, False
    q, e = re.escape(quote), re.escape(escape or quote)
    plain = F.regexp_replace("value", f"{e}{q}", "") if escape and escape != quote else F.col("value")
    inner = F.regexp_count(plain, F.lit(f"[^{q}]{q}{q}[^{q}]|{q}{q}{q}"))
    got = spark.read.text(path).agg(F.count_if(F.regexp_count(plain, F.lit(q)) % 2 == 1).alias("odd"), F.count_if(inner > 0).alias("doubled"), F.count_if(plain != F.col("value")).alias("escaped")).first()
    return got["odd"] > 0, got["doubled"] > 0 and not got["escaped"]


def read_text_table(spark: SparkSession, path: str, sep: str = ",", header: bool = True, quote: str = '"', escape: str = "\\", encoding: str = "UTF-8", nulls: Sequence[str] = NULLS, names: Sequence[str] | None = None, multi_line: bool | None = None) -> DataFrame:
    """A delimited file with all columns as strings, and the null texts as nulls.

    Files are split between tasks unless quoted fields hold line breaks (``multi_line``); by default the lines are
    looked at for that first. A file whose quotes are doubled, and nowhere escaped, is read without the escape character.
    """
    if multi_line is None or escape and escape != quote:
        ascii_like = encoding.upper().replace("_", "-") in ("UTF-8", "UTF8", "US-ASCII", "ASCII", "ISO-8859-1", "LATIN-1", "LATIN1", "WINDOWS-1252", "CP1252")
        breaks, doubled = quoting(spark, path, quote, escape) if ascii_like else (True, False)
        multi_line = breaks if multi_line is None else multi_line
        escape = quote if doubled else escape
    df = spark.read.csv(path, sep=sep, header=header, quote=quote, escape=escape, encoding=encoding, multiLine=multi_line, inferSchema=False, nullValue=None)
    if names:
        df = df.toDF(*names)
    return df.select(*(F.when(~col(c).isin(list(nulls)), col(c)).alias(c) for c in df.columns))


def typed(df: DataFrame, dates: bool = True, keep_leading_zeros: bool = True) -> DataFrame:
    """String columns as the narrowest type that fits all their values: bool, long, double, dates; else they stay.

    Numbers with leading zeros stay text unless told otherwise. One aggregate decides for all columns.
    """
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not names:
        return df
    zero = r"^[+-]?0[0-9]"
    tests = {"bool": lambda c: F.lower(c).isin("true", "false"), "long": lambda c: c.try_cast("long").isNotNull() & c.rlike(r"^\s*[+-]?[0-9]+\s*$") & (~c.rlike(zero) if keep_leading_zeros else F.lit(True)), "double": lambda c: c.try_cast("double").isNotNull() & (~c.rlike(zero) if keep_leading_zeros else F.lit(True))}
    row = df.agg(*(F.count(col(n)).alias(f"n{i}") for i, n in enumerate(names)), *(F.count_if(t(col(n))).alias(f"{k}{i}") for i, n in enumerate(names) for k, t in tests.items())).first()
    out, left = {}, []
    for i, n in enumerate(names):
        kind = next((k for k in tests if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]), None)
        if kind:
            out[n] = F.lower(col(n)).try_cast("boolean") if kind == "bool" else F.trim(col(n)).try_cast(kind)
        else:
            left.append(n)
    df = df.withColumns(out) if out else df
    return convert_dates(df, left) if dates and left else df


def upgrade_integral_floats(df: DataFrame) -> DataFrame:
    """``df`` with float columns of whole numbers only, in the range of long, as long."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not names:
        return df
    whole = lambda c: c.isNull() | F.isnan(c) | ((c == F.floor(c)) & (F.abs(c) < 2.0**53))
    row = df.agg(*(F.min(whole(col(n))).alias(f"w{i}") for i, n in enumerate(names))).first()
    new = {n: F.when(~F.isnan(col(n)), col(n)).cast("long") for i, n in enumerate(names) if row[f"w{i}"]}
    return df.withColumns(new) if new else df


def read_csv_with_metadata(spark: SparkSession, path: str, metadata=None, *, find: bool = False, upgrade_ints: bool = False, table_number: int | None = None, return_metadata: bool = False):
    """A delimited file typed by metadata: an object, a path, or (``find``) a sidecar file; without any, by its values."""
    from .csvw import find_metadata, load_metadata

    if metadata is None and find:
        metadata = find_metadata(path)
    md = load_metadata(metadata, table_number=table_number) if isinstance(metadata, str) else metadata
    if md is None:
        df = typed(read_text_table(spark, path, SEPARATORS.get(os.path.splitext(path)[1].lstrip("."), ",")))
    else:
        raw = read_text_table(spark, path, md.delimiter, md.header, md.quote, md.escape, md.encoding, md.nulls or NULLS, None if md.header else [f.name for f in md.fields])
        df = md.apply(raw)
    if upgrade_ints:
        df = upgrade_integral_floats(df)
    return (df, md) if return_metadata else df


def load(spark: SparkSession, path: str, metadata: str | None = None, infer: bool = True, conn: str | dict | None = None, **database) -> DataFrame:
    """A table by its path: parquet, delimited text (csv, psv, tsv, txt), a metadata file, ``-`` for standard input,
    ``dbtype:table`` of a database (with a connection file, or options such as ``db`` and ``host``), or the name of a
    table of the catalogue."""
    if path == "-":  # through the shared folder, as executors don't see the driver's input
        place = f"{new_place(spark)}.csv"
        spark.createDataFrame([(x,) for x in sys.stdin.read().splitlines()], "value string").coalesce(1).write.text(place)
        return load(spark, place, metadata, infer)
    if parse_table_name(path)[0] in {*JDBC, "postgresql"}:
        return read_database(spark, path, conn, **database)
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    if ext == "parquet":
        return spark.read.parquet(path)
    if ext in ("json", "yaml") and os.path.exists(path):
        from .csvw import load_metadata

        md = load_metadata(path)
        return read_csv_with_metadata(spark, os.path.join(os.path.dirname(path), md.url), md)
    if ext in SEPARATORS:
        if metadata:
            return read_csv_with_metadata(spark, path, metadata)
        df = read_text_table(spark, path, SEPARATORS[ext])
        return typed(df) if infer else df
    if spark.catalog.tableExists(path):
        return spark.table(path)
    raise ValueError(f"can't read {path}: unknown extension, and no table of that name")


#: JDBC drivers and URL forms by database (fixed values).
JDBC = {"derby": ("org.apache.derby.jdbc.EmbeddedDriver", "jdbc:derby:{db}", 0), "postgres": ("org.postgresql.Driver", "jdbc:postgresql://{host}:{port}/{db}", 5432), "mysql": ("com.mysql.cj.jdbc.Driver", "jdbc:mysql://{host}:{port}/{db}", 3306), "sqlite": ("org.sqlite.JDBC", "jdbc:sqlite:{db}", 0)}


def connection(path: str | None = None, dbtype: str | None = None, **given) -> dict[str, str]:
    """JDBC options from a JSON file (dbtype, db, host, port, user, password, schema) and keywords, which win.

    Without a path, ``~/.veriplumb_conn_<dbtype>`` is read if there is such a file.
    """
    said: dict = {}
    default = os.path.expanduser(f"~/.veriplumb_conn_{dbtype}")
    if path is None and dbtype and os.path.exists(default):
        path = default
    if path:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
    said |= {k: v for k, v in given.items() if v is not None}
    kind = {"postgresql": "postgres"}.get(k := (dbtype or said.get("dbtype") or "").lower(), k)
    if kind not in JDBC:
        raise ValueError(f"unknown database type {kind!r}")
    driver, url, port = JDBC[kind]
    out = {"driver": driver, "url": url.format(host=said.get("host", "localhost"), port=said.get("port", port), db=said.get("db") or said.get("database") or "")}
    return out | {k: said[k] for k in ("user", "password") if k in said}


def parse_table_name(name: str) -> tuple[str | None, str]:
    """``dbtype:table`` or ``table`` -> database type, table."""
    kind, mark, table = name.partition(":")
    return (kind, table) if mark else (None, name)


def read_database(spark: SparkSession, name: str, conn: str | dict | None = None, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 8, **given) -> DataFrame:
    """A database table through JDBC; Spark pushes filters and aggregates down. A bounded column splits the scan."""
    kind, table = parse_table_name(name)
    if kind == "sqlite" and not isinstance(conn, dict) and not has_driver(spark, JDBC["sqlite"][0]):
        from .sqlite import read_sqlite

        return read_sqlite(spark, connection(conn, kind, **given)["url"].removeprefix("jdbc:sqlite:"), table, partitions)
    options = conn if isinstance(conn, dict) else connection(conn, kind, **given)
    reader = spark.read.format("jdbc").options(dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    return reader.load()


def has_driver(spark: SparkSession, name: str) -> bool:
    """Whether a JDBC driver is on the driver's class path."""
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(name)
        return True
    except Exception:  # noqa: BLE001 - a Java exception, whose type depends on the bridge
        return False


def check_table_exists(spark: SparkSession, name: str, conn: str | dict | None = None, **given) -> bool:
    """Whether a table of a database (``dbtype:table``) or of the catalogue can be read."""
    if parse_table_name(name)[0] is None:
        return spark.catalog.tableExists(name)
    try:
        read_database(spark, name, conn, **given).limit(0).count()
        return True
    except ValueError:
        raise
    except Exception:  # noqa: BLE001 - what drivers raise differs
        return False


def run_script(spark: SparkSession, kind: str, path: str, conn: str | dict | None = None, **given) -> int:
    """Runs the statements of an SQL file, parted by semicolons at line ends, in a database; returns how many.

    A fixture loader: it works on one connection, from the driver.
    """
    with open(path, encoding="utf-8") as f:
        statements = [s for s in (x.strip() for x in re.split(r";[ \t]*(?:\n|$)", f.read())) if s]
    options = conn if isinstance(conn, dict) else connection(conn, kind, **given)
    if kind == "sqlite" and not has_driver(spark, options["driver"]):
        from .sqlite import run_statements

        run_statements(options["url"].removeprefix("jdbc:sqlite:"), statements)
        return len(statements)
    jvm = spark.sparkContext._jvm
    jvm.java.lang.Class.forName(options["driver"])
    link = jvm.java.sql.DriverManager.getConnection(options["url"], options.get("user"), options.get("password")) if "user" in options else jvm.java.sql.DriverManager.getConnection(options["url"])
    try:
        for s in statements:
            link.createStatement().execute(s)
    finally:
        link.close()
    return len(statements)
