"""Tables of SQLite files without a JDBC driver: each task reads a range of row ids from the shared file."""

from __future__ import annotations

import datetime
import sqlite3
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.dates import parse_date

#: Spark types by a part of the declared type (fixed values), in order of test; others are strings.
TYPES = (("INT", "long"), ("BOOL", "boolean"), ("DATETIME", "timestamp_ntz"), ("TIMESTAMP", "timestamp_ntz"), ("DATE", "date"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("NUMERIC", "double"), ("DEC", "double"))
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us"), "date": pa.date32(), "double": pa.float64(), "string": pa.string()}


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _value(v, kind: str):
    """A stored value as its column's type; text that is no date is null, and so is what can't be cast."""
    if v is None:
        return None
    try:
        if kind in ("date", "timestamp_ntz"):
            d = parse_date(v)
            return None if not isinstance(d, datetime.datetime) else d.date() if kind == "date" else d
        return {"long": int, "double": float, "boolean": lambda x: bool(int(x)), "string": lambda x: x.decode("utf-8", "replace") if isinstance(x, bytes) else str(x)}[kind](v)
    except (TypeError, ValueError):
        return None


def read_sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8, batch: int = 10_000) -> DataFrame:
    """A table of the file at ``path``, which all executors must reach. Tables without row ids are read by one task."""
    link = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        columns = [(r[1], next((t for part, t in TYPES if part in (r[2] or "").upper()), "string")) for r in link.execute(f"PRAGMA table_info({_quoted(table)})")]
        if not columns:
            raise LookupError(f"no table {table} in {path}")
        try:
            low, high = link.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
            step = -(-(high - low + 1) // partitions) if low is not None else 1
            ranges = [(a, min(a + step - 1, high)) for a in range(low, high + 1, step)] if low is not None else []
        except sqlite3.OperationalError:
            ranges = [(None, None)]
    finally:
        link.close()
    fields = ", ".join(_quoted(n) for n, _ in columns)
    schema = pa.schema([(n, ARROW[t]) for n, t in columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z in zip(b.column("a").to_pylist(), b.column("z").to_pylist(), strict=True):
                own = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
                try:
                    found = own.execute(f"SELECT {fields} FROM {_quoted(table)}" + (f" WHERE rowid BETWEEN {a} AND {z}" if a is not None else ""))
                    while rows := found.fetchmany(batch):
                        yield pa.RecordBatch.from_arrays([pa.array([_value(r[i], t) for r in rows], ARROW[t]) for i, (_, t) in enumerate(columns)], schema=schema)
                finally:
                    own.close()

    parts = spark.createDataFrame(ranges, "a long, z long").repartition(max(1, len(ranges)), "a")
    return parts.mapInArrow(read, ", ".join(f"`{n.replace('`', '``')}` {t}" for n, t in columns))


def run_statements(path: str, statements: Sequence[str]) -> None:
    with sqlite3.connect(path) as link:
        for s in statements:
            link.execute(s)
