"""Comparison of two tables: schema, rows and cells."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.rows import counts_of, with_row_numbers
from ..functions.types import col, logical_type, normalised

Option = None | bool | Sequence[str] | Callable[[DataFrame], Sequence[str]]


def chosen(option: Option, df: DataFrame) -> list[str]:
    """Columns that an option stands for: None or True all, False none, a list itself, a function what it returns."""
    if option is None or option is True:
        return list(df.columns)
    if option is False:
        return []
    return list(option(df)) if callable(option) else list(option)


def all_fields_except(names: Sequence[str]) -> Callable[[DataFrame], list[str]]:
    return lambda df: [c for c in df.columns if c not in names]


def types_match(a: T.DataType, b: T.DataType, level: str = "strict") -> bool:
    """``strict``: the same type; ``medium``: the same family whatever its width; ``permissive``: numbers and booleans too."""
    if level not in ("strict", "medium", "permissive"):
        raise ValueError(f"unknown level {level!r}")
    if a == b:
        return True
    if level == "strict":
        return False
    x, y = logical_type(a), logical_type(b)
    if x == y and x != "other":
        return True
    return level == "permissive" and {x, y} <= {"bool", "int", "real"}


@dataclass
class SchemaDiff:
    missing: list[str] = field(default_factory=list)
    extra: list[str] = field(default_factory=list)
    types: dict[str, tuple[str, str]] = field(default_factory=dict)
    order: tuple[list[str], list[str]] | None = None

    def __bool__(self) -> bool:
        return bool(self.missing or self.extra or self.types or self.order)


def schema_diff(actual: DataFrame, expected: DataFrame, check_types: Option = None, check_order: Option = None, check_extra_cols: Option = None, check_data: Option = None, type_matching: str = "strict") -> SchemaDiff:
    wanted = dict.fromkeys([*chosen(check_types, expected), *chosen(check_data, expected)])
    out = SchemaDiff(missing=[c for c in wanted if c not in actual.columns])
    extra = chosen(check_extra_cols, actual)
    out.extra = [c for c in actual.columns if c in extra and c not in expected.columns]
    for c in chosen(check_types, expected):
        if c in actual.columns and not types_match(actual.schema[c].dataType, expected.schema[c].dataType, type_matching):
            out.types[c] = (actual.schema[c].dataType.simpleString(), expected.schema[c].dataType.simpleString())
    listed = set(chosen(check_order, expected))
    mine, theirs = [c for c in actual.columns if c in listed and c in expected.columns], [c for c in expected.columns if c in listed and c in actual.columns]
    if mine != theirs:
        out.order = (mine, theirs)
    return out


def rounded(c: Column, kind: T.DataType, precision: int | None) -> Column:
    """Half-even, as NumPy rounds."""
    return F.bround(c, precision) if precision is not None and isinstance(kind, (T.FloatType, T.DoubleType)) else c


def _paired(actual: DataFrame, expected: DataFrame, key: Sequence[str], fields: Sequence[str], precision: int | None) -> DataFrame:
    """Rows of both, joined by ``key``: structs ``key, a, b``; a side that lacks the key is null."""
    sides = []
    for df, name in ((normalised(actual), "a"), (normalised(expected), "b")):
        cells = (rounded(col(c), df.schema[c].dataType, precision).alias(c) for c in fields)
        sides.append(df.select(F.struct(*(col(k) for k in key)).alias("key"), F.struct(F.lit(True).alias("__"), *cells).alias(name)))
    return sides[0].join(sides[1], "key", "full")


def _shared_fields(actual: DataFrame, expected: DataFrame, key: Sequence[str], fields: Sequence[str] | None) -> list[str]:
    return [c for c in (fields if fields is not None else expected.columns) if c not in key and c in actual.columns and c in expected.columns]


def _differs(c: str) -> Column:
    return ~F.col("a").getField(c).eqNullSafe(F.col("b").getField(c))


def cell_masks(actual: DataFrame, expected: DataFrame, key: Sequence[str], fields: Sequence[str] | None = None, precision: int | None = 6) -> DataFrame:
    """Rows of both, joined by ``key``: the key, ``in_actual``, ``in_expected``, and for each field whether it differs.

    Two nulls are equal, and NaN is null. A row of one side alone differs in all fields. Keys should be unique.
    """
    fields = _shared_fields(actual, expected, key, fields)
    both = _paired(actual, expected, key, fields, precision)
    alone = F.col("a").isNull() | F.col("b").isNull()
    masks = [(alone | _differs(c)).alias(c) for c in fields]
    return both.select("key.*", F.col("a").isNotNull().alias("in_actual"), F.col("b").isNotNull().alias("in_expected"), *masks)


def with_occurrence(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """``df`` with a number for each row among those of its key, in the order of the other columns that can be ordered."""
    others = [col(f.name) for f in df.schema.fields if f.name not in key and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(col(k) for k in key)).orderBy(*(others or [F.lit(0)]))))


def diff_counts(masks: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, n_diffs`` for each row."""
    fields = [c for c in masks.columns if c not in (*key, "in_actual", "in_expected")]
    total = sum((col(c).cast("int") for c in fields), F.lit(0))
    return masks.select(*(col(k) for k in key), total.cast("long").alias("n_diffs"))


@dataclass
class TableDiff:
    """What differs, with the masks of rows to look at."""

    schema: SchemaDiff
    n_actual: int | None = None
    n_expected: int | None = None
    n_values: int = 0
    n_rows: int = 0
    by_column: dict[str, int] = field(default_factory=dict)
    masks: DataFrame | None = None
    sample: list = field(default_factory=list)

    def __bool__(self) -> bool:
        return bool(self.schema or self.n_values or self.n_rows or self.n_actual != self.n_expected)

    @property
    def messages(self) -> list[str]:
        s, out = self.schema, []
        if s.missing:
            out.append(f"Missing columns: {', '.join(s.missing)}")
        if s.extra:
            out.append(f"Extra columns: {', '.join(s.extra)}")
        out += [f"Column {c}: type {a}, expected {b}" for c, (a, b) in s.types.items()]
        if s.order:
            out.append(f"Wrong column order: {', '.join(s.order[0])}; expected {', '.join(s.order[1])}")
        if self.n_actual != self.n_expected:
            out.append(f"Found {self.n_actual:,} rows; expected {self.n_expected:,}")
        if self.n_values:
            out.append(f"{self.n_values:,} values differ, in {len(self.by_column):,} columns and {self.n_rows:,} rows: " + ", ".join(f"{c} ({n:,})" for c, n in self.by_column.items()))
            out += [f"  {r}" for r in self.sample]
        return out

    def __str__(self) -> str:
        return "\n".join(self.messages)


def _counted(paired: DataFrame, fields: Sequence[str], keys: Sequence[str], sample: int) -> tuple[dict, list]:
    """Counts of rows and differences, and the first ``sample`` differing pairs in order of key: one pass over the join."""
    here, there = F.col("a").isNotNull(), F.col("b").isNotNull()
    masks = [here & there & _differs(c) for c in fields]
    some = F.greatest(*masks, F.lit(False)) if masks else F.lit(False)
    counts = [F.count_if(here).alias("a"), F.count_if(there).alias("e"), F.count_if(some).alias("rows"), *(F.count_if(m).alias(f"d{i}") for i, m in enumerate(masks))]
    if not sample:
        return paired.agg(*counts).first().asDict(), []
    watch = Observation()
    first = paired.observe(watch, *counts).filter(some).orderBy(*(F.col("key").getField(k) for k in keys)).limit(sample).collect()
    return counts_of(watch, paired, counts), first


def compare(actual: DataFrame, expected: DataFrame, *, key: str | Sequence[str] | None = None, check_data: Option = None, check_types: Option = None, check_order: Option = None, check_extra_cols: Option = None, sortby: Sequence[str] | None = None, condition: Column | Callable[[DataFrame], Column] | None = None, precision: int | None = 6, type_matching: str = "strict", sample: int = 10) -> TableDiff:
    """Differences of two tables.

    Rows are matched by ``key`` if given, else by position, after ``sortby``; ties are sorted by the columns that both
    tables have. ``condition`` filters both sides. Cells are compared in one full join, whose counts and ``sample`` of
    differing rows come from one pass. Rows that share a key are matched in the order of their other columns; that
    takes a second pass, made if the join has more rows than either side.
    """
    out = TableDiff(schema_diff(actual, expected, check_types, check_order, check_extra_cols, check_data, type_matching))
    if condition is not None:
        actual, expected = (d.filter(condition(d) if callable(condition) else condition) for d in (actual, expected))
    fields = [c for c in chosen(check_data, expected) if c in actual.columns]
    keys = [key] if isinstance(key, str) else list(key or [])
    if not fields:
        out.n_actual, out.n_expected = actual.count(), expected.count()
        return out
    if not keys:
        if sortby and all(c in d.columns for d in (actual, expected) for c in sortby):
            ties = [f.name for f in expected.schema.fields if f.name not in sortby and f.name in actual.columns and logical_type(f.dataType) != "other"]
            actual, expected = (d.orderBy(*(col(c) for c in (*sortby, *ties))) for d in (actual, expected))
        keys = ["__row"]
        actual, expected = (with_row_numbers(d, "__row", 0) for d in (actual, expected))
    names = _shared_fields(actual, expected, keys, fields)
    found, first = _counted(_paired(actual, expected, keys, names, precision), names, keys, sample)
    if keys != ["__row"] and (found["a"], found["e"]) != (actual.count(), expected.count()):
        shown, keys = len(keys), [*keys, "__nth"]
        actual, expected = (with_occurrence(d.select(*(col(c) for c in dict.fromkeys((*keys[:shown], *names)))), keys[:shown], "__nth") for d in (actual, expected))
        found, first = _counted(_paired(actual, expected, keys, names, precision), names, keys, sample)
    out.n_actual, out.n_expected, out.n_rows = found["a"], found["e"], found["rows"]
    out.by_column = {c: found[f"d{i}"] for i, c in enumerate(names) if found[f"d{i}"]}
    out.n_values, out.masks = sum(out.by_column.values()), cell_masks(actual, expected, keys, fields, precision)
    out.sample = [f"{tuple(r['key'])}: actual {tuple(r['a'][c] for c in out.by_column)}, expected {tuple(r['b'][c] for c in out.by_column)}" for r in first]
    return out
