"""Constraints that a table's own data satisfy."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame

from ..functions.types import field_types
from .model import Constraint, DatasetConstraints, FieldConstraints
from .profile import ColumnProfile, profile


def sign_of(low, high) -> str | None:
    """The sign constraint of values between two bounds, if there is one."""
    if low is None or high is None:
        return None
    if low == high == 0:
        return "zero"
    if low >= 0:
        return "positive" if low > 0 else "non-negative"
    if high <= 0:
        return "negative" if high < 0 else "non-positive"
    return None


def field_constraints(p: ColumnProfile, rexes: list[str] | None = None) -> FieldConstraints | None:
    """Constraints from a profile: a pure function. A column of type ``other`` has none, an empty one just its type."""
    if p.type == "other":
        return None
    found = [Constraint("type", p.type)]
    if p.n:
        if p.n_nulls < 2:
            found.append(Constraint("max_nulls", p.n_nulls))
        if p.n_nonnull:
            if p.type == "string":
                found += [Constraint("min_length", p.min_length), Constraint("max_length", p.max_length)]
                if p.values:
                    found.append(Constraint("allowed_values", list(p.values)))
            else:
                found += [Constraint("min", p.min), Constraint("max", p.max)]
                if p.type != "date" and (sign := sign_of(p.min, p.max)):
                    found.append(Constraint("sign", sign))
            if p.type in ("string", "int") and p.n_distinct is not None and p.n_distinct > 1 and p.unique:
                found.append(Constraint("no_duplicates", True))
    if rexes is not None and p.type == "string":
        found.append(Constraint("rex", rexes))
    return FieldConstraints(p.name, found)


def discover_df(df: DataFrame, inc_rex: bool = False, seed: int | None = None, dataset: str | None = None, source: str | None = None, kinds: Collection[str] | None = None) -> DatasetConstraints | None:
    """Constraints of all fields, or None if no field has any. ``inc_rex`` adds regular expressions of string fields.

    ``kinds`` limits them to some kinds; distinct values are counted just for kinds that need them.
    """
    wants = lambda kind: kinds is None or kind in kinds
    profiles, _ = profile(df, distinct=None if wants("no_duplicates") else (), values=wants("allowed_values"))
    fields = []
    for name in field_types(df):
        rexes = None
        if inc_rex and wants("rex") and profiles[name].type == "string":
            from .rexinfer import infer

            rexes = infer(df, name, seed=seed).rex
        if f := field_constraints(profiles[name], rexes):
            fields.append(FieldConstraints(name, [c for c in f if wants(c.kind)]))
    if not fields:
        return None
    out = DatasetConstraints(fields)
    out.stamp(n_records=next(iter(profiles.values())).n, dataset=dataset, source=source)
    return out


def discover_table(spark, name: str, inc_rex: bool = False, seed: int | None = None) -> DatasetConstraints | None:
    """Constraints of a table of the catalogue."""
    return discover_df(spark.table(name), inc_rex, seed, dataset=name, source=name)
