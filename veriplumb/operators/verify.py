"""Verification: which constraints a table satisfies."""

from __future__ import annotations

import datetime
import logging
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.regexes import matches_any
from ..functions.types import coarse, col, field_types, normalised
from .model import KINDS, Constraint, DatasetConstraints
from .profile import ColumnProfile, not_boolean, profile

log = logging.getLogger("veriplumb")
MARKS = {True: "✓", False: "✗", None: "-"}
ASCII_MARKS = {True: "OK", False: "X", None: "-"}


def as_constraints(said) -> DatasetConstraints:
    if isinstance(said, DatasetConstraints):
        return said
    return DatasetConstraints.from_dict(said) if isinstance(said, dict) else DatasetConstraints(path=said)


def fuzzy_bound(value, epsilon: float, low: bool):
    """A bound moved outward by a share of itself; dates and texts don't move."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return value
    return value * (1 - epsilon) if (value >= 0) == low else value * (1 + epsilon)


def kind_of_value(v) -> str:
    if isinstance(v, (bool, int, float)):
        return "number"
    return "date" if isinstance(v, (datetime.date, datetime.datetime)) else "string"


def _comparable(v):
    """Numbers as they are, dates as datetimes without zone."""
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day)
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def bound_holds(c: Constraint, found, epsilon: float) -> bool:
    low = c.kind == "min"
    v, m = _comparable(c.value), _comparable(found)
    precision = c.precision or "fuzzy"
    if kind_of_value(v) != "number":
        precision = "open" if precision == "open" and kind_of_value(v) == "string" else "closed"
    if precision == "open":
        return m > v if low else m < v
    if precision == "fuzzy" and epsilon:
        v = min(v, fuzzy_bound(v, epsilon, True)) if low else max(v, fuzzy_bound(v, epsilon, False))
    return m >= v if low else m <= v


def violations(name: str, kind: str, c: Constraint) -> Column | None:
    """An aggregate that counts rows against a constraint that column statistics don't decide."""
    if kind != "string" and c.kind == "rex" or c.value is None:
        return None
    if c.kind == "allowed_values":
        listed = [x for x in c.value if x is not None]
        return F.count_if(col(name).isNotNull() & ~_listed(col(name), listed))
    if c.kind == "rex":
        return F.count_if(~matches_any(col(name), c.value))
    if c.kind == "type" and kind == "string" and "bool" in (c.value if isinstance(c.value, list) else [c.value]):
        return F.count_if(not_boolean(name))
    return None


def violating_values(df: DataFrame, name: str, constraint: Constraint | tuple[str, list]) -> DataFrame:
    """``value, n``: distinct values of a column that break an ``allowed_values`` or ``rex`` constraint, with their rows."""
    c = constraint if isinstance(constraint, Constraint) else Constraint(*constraint)
    if c.kind not in ("allowed_values", "rex"):
        raise ValueError(f"values don't break a constraint of kind {c.kind} one by one")
    rows = normalised(df.select(col(name))).filter(col(name).isNotNull()).groupBy(col(name).alias("value")).agg(F.count("*").alias("n"))
    if c.value is None:
        return rows.limit(0)
    return rows.filter(~_listed(F.col("value"), [x for x in c.value if x is not None]) if c.kind == "allowed_values" else ~matches_any(F.col("value"), c.value))


def _listed(c: Column, values: list) -> Column:
    return c.isin(values) if values else F.lit(False)


def holds(c: Constraint, p: ColumnProfile | None, against: int | None = None, epsilon: float = 0.0, type_checking: str = "sloppy") -> bool | None:
    """Whether a column's profile satisfies a constraint: a pure function. None if nothing can verify it."""
    if c.kind not in KINDS or c.kind == "transform":
        return None
    if p is None:
        return False
    v = c.value
    if v is None:
        return True
    if c.kind in ("min", "max"):
        if p.n_nonnull == 0:
            return True
        if kind_of_value(v) != coarse(p.type):
            log.warning("field %s: %s constraint %r doesn't fit its type %s", p.name, c.kind, v, p.type)
            return False
        return bound_holds(c, p.min if c.kind == "min" else p.max, epsilon)
    if c.kind in ("min_length", "max_length"):
        if p.type != "string":
            return False
        return p.n_nonnull == 0 or (p.min_length >= v if c.kind == "min_length" else p.max_length <= v)
    if c.kind == "type":
        allowed = v if isinstance(v, list) else [v]
        if p.type in allowed:
            return True
        if type_checking != "sloppy":
            return False
        if p.type == "string":  # text of booleans alone
            return "bool" in allowed and against == 0
        return p.type == "real" and p.non_integral == 0 and bool({"int", "bool"} & set(allowed))
    if c.kind == "sign":
        if v == "null":
            return p.n_nonnull == 0
        if p.n_nonnull == 0:
            return True
        if coarse(p.type) != "number":
            return False
        return {"positive": p.min > 0, "non-negative": p.min >= 0, "zero": p.min == p.max == 0, "non-positive": p.max <= 0, "negative": p.max < 0}[v]
    if c.kind == "max_nulls":
        return p.n_nulls <= v
    if c.kind == "no_duplicates":
        return not v or p.unique
    if c.kind == "allowed_values":
        return against == 0
    return p.type == "string" and against == 0  # rex


@dataclass
class Verification:
    """Results by field and kind, in the order of the table's fields."""

    results: dict[str, dict[str, bool | None]]
    report: str = "all"
    ascii: bool = False
    detection: object = None
    profiles: dict[str, ColumnProfile] = field(default_factory=dict)

    @property
    def passes(self) -> int:
        return sum(r is True for f in self.results.values() for r in f.values())

    @property
    def failures(self) -> int:
        return sum(r is False for f in self.results.values() for r in f.values())

    def detected(self) -> DataFrame | None:
        return self.detection.df if self.detection else None

    def __str__(self) -> str:
        marks = ASCII_MARKS if self.ascii else MARKS
        lines = []
        for name, kinds in self.results.items():
            bad, ok = sum(r is False for r in kinds.values()), sum(r is True for r in kinds.values())
            if self.report == "all" or self.report == "fields" and bad:
                count = lambda n, one, many: f"{n} {one if n == 1 else many}"
                lines.append(f"{name}: {count(bad, 'failure', 'failures')}  {count(ok, 'pass', 'passes')}  " + "  ".join(f"{k} {marks[r]}" for k, r in kinds.items()))
        out = "FIELDS:\n\n" + "\n\n".join(lines) + "\n\n" if lines and self.report != "records" else ""
        out += f"SUMMARY:\n\nConstraints passing: {self.passes}\nConstraints failing: {self.failures}"
        if self.detection:
            out += f"\nRecords passing: {self.detection.n_passing}\nRecords failing: {self.detection.n_failing}"
        return out

    def to_df(self, spark: SparkSession) -> DataFrame:
        """One row per field: field, failures, passes and a nullable boolean per kind that occurs."""
        used = [k for k in KINDS if any(k in f for f in self.results.values())]
        fields = [T.StructField("field", T.StringType()), T.StructField("failures", T.LongType()), T.StructField("passes", T.LongType()), *(T.StructField(k, T.BooleanType()) for k in used)]
        rows = [(n, sum(r is False for r in f.values()), sum(r is True for r in f.values()), *(f.get(k) for k in used)) for n, f in self.results.items()]
        return spark.createDataFrame(rows, T.StructType(fields))


def repaired(df: DataFrame, constraints: DatasetConstraints) -> DataFrame:
    """``df`` with columns cast that a reader mistook: to string where so constrained, int 0/1 to bool, text to dates."""
    kinds = field_types(df)
    out = []
    for f in df.schema.fields:
        want = constraints[f.name].value("type") if f.name in constraints else None
        c, have = col(f.name), kinds[f.name]
        if want == "string" and have in ("int", "real", "bool", "date"):
            c = F.regexp_replace(c.cast("string"), r"\.0$", "")
        elif want == "bool" and have == "string":
            c = F.lower(c).try_cast("boolean")
        elif want == "bool" and have in ("int", "real"):
            c = F.when(c.isNull() | c.isin(0, 1), c.cast("boolean"))
        elif want == "date" and have == "string":
            c = c.try_cast("timestamp_ntz")
        out.append(c.alias(f.name))
    fixed = df.select(*out)
    bad = [n for n in df.columns if fixed.schema[n].dataType != df.schema[n].dataType]
    if bad:  # a cast that loses values is undone
        lost = df.select(*(F.count(col(n)).alias(f"a{i}") for i, n in enumerate(bad))).first()
        kept = fixed.select(*(F.count(col(n)).alias(f"a{i}") for i, n in enumerate(bad))).first()
        undo = {n for i, n in enumerate(bad) if lost[f"a{i}"] != kept[f"a{i}"]}
        fixed = df.select(*((col(f.name) if f.name in undo else c).alias(f.name) for f, c in zip(df.schema.fields, out, strict=True)))
    return fixed


def verify_df(df: DataFrame, constraints, epsilon: float | None = None, type_checking: str = "sloppy", repair: bool = False, report: str = "all", ascii: bool = False) -> Verification:
    """Verification of ``df`` against constraints (an object, a dict or a path), in one pass over the columns they name."""
    constraints = as_constraints(constraints)
    if repair:
        df = repaired(df, constraints)
    kinds = field_types(df)
    order = {n: i for i, n in enumerate(df.columns)}
    named = sorted(constraints, key=lambda f: order.get(f.name, -1))
    there = [f for f in named if f.name in kinds]
    extra = {f"{f.name}\0{c.kind}": a for f in there for c in f if (a := violations(f.name, kinds[f.name], c)) is not None}
    distinct = [f.name for f in there if f.value("no_duplicates")]
    used = df.select(*(col(f.name) for f in there)) if there else df.select()
    profiles, counts = profile(used, distinct=distinct, values=False, extra=extra) if there else ({}, {})
    results = {f.name: {c.kind: holds(c, profiles.get(f.name), counts.get(f"{f.name}\0{c.kind}"), epsilon or 0.0, type_checking) for c in f} for f in named}
    return Verification(results, report, ascii, profiles=profiles)


def verify_table(spark: SparkSession, name: str, constraints, **options) -> Verification:
    """Verification of a table of the catalogue."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table {name}")
    return verify_df(spark.table(name), constraints, **options)


__all__ = ["Verification", "as_constraints", "bound_holds", "fuzzy_bound", "holds", "normalised", "repaired", "verify_df", "verify_table", "violating_values"]
