"""Row numbers without a sort or a window over all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .staging import staged
from .types import col


def settled(df: DataFrame) -> bool:
    """Whether each run of ``df`` sees the same partitions: true of plans without an exchange, as of files and tables.

    Adaptive execution cuts the output of an exchange as the columns in use suggest, so that two jobs may differ.
    """
    try:
        return "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    except AttributeError:  # a remote session doesn't show its plan
        return False


def split_of(df: DataFrame) -> list[Column]:
    """What tells and orders the splits of the files that ``df`` reads: folder, number of the part, file and first byte.

    Spark packs files into tasks by size, so partitions are not in the order of the files. No columns for plans that do
    more than read, filter and select, as a sort may mix the rows of a task's splits.
    """
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.children().size() == 1 and plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    path = F.col("_metadata.file_path")
    part = F.regexp_extract(path, r"/part-(\d{1,18})[^/]*$", 1).try_cast("long")
    split = [F.regexp_extract(path, "^(.*/)", 1), part, path, F.col("_metadata.file_block_start")]
    try:
        return split if plan.children().isEmpty() and df.select(*split).columns else []
    except AnalysisException:
        return []


def with_row_numbers(df: DataFrame, name: str, first: int = 1) -> DataFrame:
    """``df`` with consecutive numbers in the order of its files and their rows, or else of its partitions.

    Each row gets its partition, or its split of a file, and its place there; a table of one row for each says where they
    start. Where two jobs might see different partitions the placed rows are staged first, so that both read the same ones.
    """
    at, start = (f"__{k}{len(df.columns)}_{name}" for k in ("at", "start"))
    fixed = settled(df)
    split = (split_of(df) if fixed else []) or [F.spark_partition_id()]
    parts = [f"__part{len(df.columns)}_{i}_{name}" for i in range(len(split))]
    placed = df.select("*", *(s.alias(p) for s, p in zip(split, parts, strict=True)), F.monotonically_increasing_id().alias(at))
    if not fixed:
        placed = staged(placed)
    keys = [col(p) for p in parts]
    counts = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.min(col(at)).alias("least"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*(k.alias(f"{p}_") for k, p in zip(keys, parts, strict=True)), (before - F.col("least")).alias(start))
    same = [k.eqNullSafe(col(f"{p}_")) for k, p in zip(keys, parts, strict=True)]
    joined = placed.join(F.broadcast(starts), same)
    return joined.select(*(col(c) for c in df.columns if c != name), (col(start) + col(at) + F.lit(first)).cast("long").alias(name))


def counts_of(watch: Observation, df: DataFrame, totals: Sequence[Column]) -> dict:
    """What ``watch`` has seen, or the aggregates themselves where the optimizer has cut the observed rows away."""
    try:
        return watch.get
    except Exception:  # noqa: BLE001 - an assertion of the JVM, whose type depends on the bridge
        return df.agg(*totals).first().asDict()
