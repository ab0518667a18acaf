"""Detection: the rows that break constraints which a table fails."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.regexes import matches_any
from ..functions.rows import counts_of, with_row_numbers
from ..functions.types import coarse, col, field_types, normalised
from ..sources.writers import check_writable, save
from .model import KINDS, Constraint
from .verify import Verification, _listed, as_constraints, fuzzy_bound, kind_of_value, repaired, verify_df


@dataclass
class Detection:
    """Rows with their flags. Rows that pass and fail are counted when they are asked for, unless writing has counted them."""

    df: DataFrame
    counts: Callable[[], tuple[int, int]]

    @cached_property
    def _totals(self) -> tuple[int, int]:
        return self.counts()

    @property
    def n_passing(self) -> int:
        return self._totals[0] - self._totals[1]

    @property
    def n_failing(self) -> int:
        return self._totals[1]


def free_name(name: str, taken: Sequence[str]) -> str:
    """``name``, or with the first suffix _2, _3, ... that is free."""
    out, i = name, 1
    while out in taken:
        i += 1
        out = f"{name}_{i}"
    return out


def row_flag(name: str, kind: str, c: Constraint, epsilon: float) -> Column | None:
    """True for rows that satisfy a constraint, False for others, null where it doesn't apply; None for no flag."""
    x, v, never = col(name), c.value, F.lit(False)
    if c.kind in ("min", "max"):
        if kind_of_value(v) != coarse(kind):
            return never
        bound = v
        fuzzy = kind_of_value(v) == "number" and (c.precision or "fuzzy") == "fuzzy" and epsilon
        if fuzzy:
            bound = (min if c.kind == "min" else max)(v, fuzzy_bound(v, epsilon, c.kind == "min"))
        open_ = c.precision == "open" and kind_of_value(v) != "date"
        value = x.cast("double") if kind == "bool" else x
        return {("min", True): value > bound, ("min", False): value >= bound, ("max", True): value < bound, ("max", False): value <= bound}[c.kind, open_]
    if c.kind in ("min_length", "max_length"):
        if kind != "string":
            return never
        return F.char_length(x) >= v if c.kind == "min_length" else F.char_length(x) <= v
    if c.kind == "type":
        return never
    if c.kind == "sign":
        if v == "null":
            return never
        if coarse(kind) != "number":
            return None
        n = x.cast("double")
        return {"positive": n > 0, "non-negative": n >= 0, "zero": n == 0, "non-positive": n <= 0, "negative": n < 0}[v]
    if c.kind == "max_nulls":
        return x.isNotNull()
    if c.kind == "allowed_values":
        return F.when(x.isNotNull(), _listed(x, [y for y in v if y is not None]))
    return matches_any(x, v) if kind == "string" else never  # rex


def _with_duplicate_flag(df: DataFrame, name: str, flag: str) -> DataFrame:
    """All rows of a repeated value are False, null rows True. Values are counted first, then joined: no window over a
    hot value, and Spark can split its join."""
    value, n = free_name("__value", df.columns), free_name("__n", df.columns)
    again = df.filter(col(name).isNotNull()).groupBy(col(name).alias(value)).agg(F.count("*").alias(n)).filter(col(n) > 1).select(col(value), F.lit(False).alias(flag))
    joined = df.join(again, col(name) == col(value), "left").drop(value)
    return joined.withColumn(flag, F.coalesce(col(flag), F.lit(True)))


def detect_df(
    df: DataFrame, constraints, epsilon: float | None = None, type_checking: str = "sloppy", outpath: str | None = None, write_all: bool = False, per_constraint: bool = False,
    output_fields: Sequence[str] | None = None, index: bool = False, in_place: bool = False, boolean_ints: bool = False, repair: bool = False, report: str = "records", interleave: bool = False,
    row_number: str = "RowNumber", first_row: int = 1, key: str | Sequence[str] | None = None,
) -> Verification:
    """Verification of ``df``, with a detection of failing rows if any constraint fails.

    The detection's DataFrame has an id of each row (``key`` columns, else a row number), the chosen ``output_fields``
    (None: none, an empty list: all), a flag per failing constraint if ``per_constraint``, and ``n_failures``. Only
    failing rows are kept unless ``write_all``. ``in_place`` gives all columns of ``df`` and the flags. ``outpath``
    (parquet, csv, ...) writes it, and is tested before any work. Constraints on missing columns have no flags; the
    counts are over all rows.
    """
    if outpath:
        check_writable(df.sparkSession, outpath)
    constraints = as_constraints(constraints)
    if repair:
        df = repaired(df, constraints)
    result = verify_df(df, constraints, epsilon, type_checking, report=report)
    kinds = field_types(df)
    failing = [(f, constraints[f][k]) for f, ks in result.results.items() if f in kinds for k, r in ks.items() if r is False]
    if not failing:
        return result
    unknown = [f for f in output_fields or [] if f not in df.columns]
    if unknown:
        raise ValueError(f"no such output fields: {unknown}")
    fields = list(df.columns) if in_place or output_fields == [] else list(output_fields or [])
    ids = [key] if isinstance(key, str) else list(key or [])
    rows = normalised(df)
    if not ids and (index or not in_place):
        ids = [free_name(row_number, df.columns)]
        rows = with_row_numbers(rows, ids[0], first_row)
    flags: dict[str, list[str]] = {}
    for f, c in failing:
        name = free_name(f"{f}_{KINDS[c.kind]}_ok", rows.columns)
        if c.kind == "no_duplicates":
            rows = _with_duplicate_flag(rows, f, name)
        else:
            flag = row_flag(f, kinds[f], c, epsilon or 0.0)
            if flag is None:
                continue
            rows = rows.withColumn(name, flag)
        flags.setdefault(f, []).append(name)
    every = [n for ns in flags.values() for n in ns]
    count = free_name("n_failures", df.columns)
    bad = reduce(lambda a, b: a + b, (F.when(~col(n), 1).otherwise(0) for n in every), F.lit(0))
    rows = rows.withColumn(count, bad.cast("long"))
    totals = (F.count(F.lit(1)).alias("n"), F.count_if(col(count) > 0).alias("bad"))
    whole, watch = rows, Observation()
    if outpath:
        rows = rows.observe(watch, *totals)
    shown = every if per_constraint or in_place else []
    if boolean_ints and shown:
        rows = rows.withColumns({n: col(n).cast("int") for n in shown})
    lead = [i for i in ids if i not in fields]
    if interleave and shown and set(df.columns) <= {*fields, *ids}:
        body = [x for f in fields for x in (f, *(n for n in flags.get(f, []) if n in shown))]
    else:
        body = [*fields, *shown]
    out = rows.select(*(col(n) for n in [*lead, *body, count]))
    if not write_all and not in_place:
        out = out.filter(col(count) > 0)
    if outpath:  # counted while it is written
        save(out, outpath, boolean_ints=boolean_ints)
        result.detection = Detection(out, lambda: tuple(counts_of(watch, whole, totals).values()))
    else:
        result.detection = Detection(out, lambda: tuple(whole.agg(*totals).first()))
    return result


def detect_table(spark, name: str, constraints, **options) -> Verification:
    """Detection in a table of the catalogue."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table {name}")
    return detect_df(spark.table(name), constraints, **options)


def observed(df: DataFrame, constraints, name: str = "constraints") -> tuple[DataFrame, Observation]:
    """``df`` unchanged, and an observation that counts rows against each row-wise constraint while it is used elsewhere."""
    kinds = field_types(df)
    watch = Observation(name)
    counts = [F.count(F.lit(1)).alias("n_records")]
    for f in as_constraints(constraints):
        for c in f:
            if f.name in kinds and c.kind != "no_duplicates" and c.kind in KINDS and c.kind not in ("type", "transform") and c.value is not None and (flag := row_flag(f.name, kinds[f.name], c, 0.0)) is not None:
                counts.append(F.count_if(~flag).alias(f"{f.name}_{KINDS[c.kind]}_failures"))
    return df.observe(watch, *counts), watch
