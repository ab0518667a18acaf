"""Column statistics in one aggregate, with exact distinct counts just where an estimate leaves them open."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import col, field_types, normalised

#: String columns with at most so many values get a list of them.
MAX_CATEGORIES = 20
#: Columns whose distinct values are counted in one job: each of them multiplies the rows that are shuffled.
DISTINCT_BATCH = 8
#: Relative error of distinct estimates, and the factor by which an estimate may be off before it is trusted.
ESTIMATE, MARGIN = 0.02, 1.25


@dataclass
class ColumnProfile:
    name: str
    type: str
    n: int
    n_nonnull: int
    min: object = None
    max: object = None
    min_length: int | None = None
    max_length: int | None = None
    non_integral: int | None = None
    n_distinct: int | None = None
    values: list | None = None

    @property
    def n_nulls(self) -> int:
        return self.n - self.n_nonnull

    @property
    def unique(self) -> bool:
        return self.n_distinct == self.n_nonnull


def statistics(name: str, kind: str, estimate: bool = True) -> dict[str, Column]:
    """The aggregates of one column; ``estimate`` adds an approximate number of distinct values."""
    c = col(name)
    out = {"n_nonnull": F.count(c)}
    if kind in ("bool", "int", "real", "date", "string"):
        out |= {"min": F.min(c), "max": F.max(c)}
    if kind == "string":
        out |= {"min_length": F.min(F.char_length(c)), "max_length": F.max(F.char_length(c))}
    if kind == "real":
        out["non_integral"] = F.count_if(c != F.floor(c))
    if estimate and kind in ("string", "int"):
        out["estimate"] = F.approx_count_distinct(c, ESTIMATE)
    return out


def exact_distinct(df: DataFrame, names: Iterable[str]) -> dict[str, int]:
    names = list(names)
    out: dict[str, int] = {}
    for a in range(0, len(names), DISTINCT_BATCH):
        batch = names[a : a + DISTINCT_BATCH]
        row = df.agg(*(F.count_distinct(col(n)).alias(f"d{i}") for i, n in enumerate(batch))).first()
        out |= {n: row[f"d{i}"] for i, n in enumerate(batch)}
    return out


def profile(df: DataFrame, fields: Iterable[str] | None = None, distinct: Iterable[str] | None = None, values: bool = True, extra: Mapping[str, Column] | None = None) -> tuple[dict[str, ColumnProfile], dict[str, object]]:
    """Profiles of ``fields`` (all by default), and the values of ``extra`` aggregates, from one pass.

    ``n_distinct`` is exact where given. By default it is counted for string and int columns that may be unique or have
    few values, as an estimate in the first pass tells; for others it is None. ``distinct`` names columns that need it;
    then, and without ``values``, nothing is estimated. Only the columns that are asked for are read.
    """
    kinds = {n: k for n, k in field_types(df).items() if fields is None or n in set(fields)}
    df = normalised(df) if extra else normalised(df.select(*(col(n) for n in kinds)))
    plan = {(n, s): c for n, k in kinds.items() for s, c in statistics(n, k, values or distinct is None).items()}
    keys = list(plan)
    more = dict(extra or {})
    row = df.agg(F.count(F.lit(1)).alias("n"), *(plan[k].alias(f"s{i}") for i, k in enumerate(keys)), *(c.alias(f"x{i}") for i, c in enumerate(more.values()))).first()
    got = {k: row[f"s{i}"] for i, k in enumerate(keys)}
    out = {n: ColumnProfile(n, k, row["n"], got[n, "n_nonnull"], *(got.get((n, s)) for s in ("min", "max", "min_length", "max_length", "non_integral"))) for n, k in kinds.items()}
    guess = {n: got[n, "estimate"] for n in kinds if (n, "estimate") in got}
    few = [n for n, g in guess.items() if kinds[n] == "string" and 0 < g <= MAX_CATEGORIES * MARGIN] if values else []
    wanted = set(distinct) & set(kinds) if distinct is not None else {n for n, g in guess.items() if g * MARGIN >= out[n].n_nonnull and out[n].n_nonnull > 1}
    if few:
        sets = df.agg(*(F.sort_array(F.collect_set(col(n))).alias(f"v{i}") for i, n in enumerate(few))).first()
        for i, n in enumerate(few):  # sets of at most MAX_CATEGORIES * MARGIN**2 or so values
            out[n].n_distinct = len(sets[f"v{i}"])
            if out[n].n_distinct <= MAX_CATEGORIES:
                out[n].values = sets[f"v{i}"]
    for n, d in exact_distinct(df, [n for n in kinds if n in wanted and out[n].n_distinct is None]).items():
        out[n].n_distinct = d
    return out, {k: row[f"x{i}"] for i, k in enumerate(more)}


def all_booleans(df: DataFrame, name: str) -> bool:
    """Whether all non-null values of a column are booleans, or the texts true and false in any case."""
    kind = field_types(df)[name]
    if kind != "string":
        return kind == "bool"
    return df.filter(not_boolean(name)).isEmpty()


def not_boolean(name: str) -> Column:
    return col(name).isNotNull() & ~F.lower(col(name)).isin("true", "false")


def profile_table(df: DataFrame) -> DataFrame:
    """One row per column: field, type, n_records, n_nulls, min, max (as text), lengths, non_integral."""
    kinds = field_types(df)
    df = normalised(df)
    structs = []
    for n, k in kinds.items():
        s = statistics(n, k)
        text = lambda key: s[key].cast("string") if key in s else F.lit(None).cast("string")  # noqa: B023, E731
        number = lambda key: s[key].cast("long") if key in s else F.lit(None).cast("long")  # noqa: B023, E731
        structs.append(F.struct(F.lit(n).alias("field"), F.lit(k).alias("type"), F.count(F.lit(1)).alias("n_records"), (F.count(F.lit(1)) - s["n_nonnull"]).alias("n_nulls"), text("min").alias("min"), text("max").alias("max"), number("min_length").alias("min_length"), number("max_length").alias("max_length"), number("non_integral").alias("non_integral")))
    return df.agg(F.array(*structs).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def unique_values(df: DataFrame, name: str, include_nulls: bool = False) -> DataFrame:
    """Distinct values in ascending order, nulls first if they are included."""
    d = normalised(df.select(col(name))).distinct()
    return (d if include_nulls else d.filter(col(name).isNotNull())).orderBy(col(name).asc_nulls_first())
