"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

The mix shares a number of words over the sources by weight. A source stops at ``max_epochs`` times its size; what it
can't take goes to the others by weight, until no source is above its stop. With sources in order of stop / weight the
stopped ones are a prefix, so running sums give the level at once, without iterating.

A source's target is some whole repetitions of all its documents and a fractional one. The fractional repetition takes
documents in a seeded order until its words are used up; the document at the edge gives only its first words. A source's
taken words so equal its target, up to rounding to a word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, staged

#: Seeded order is cut into so many runs per source, whose sums make the running sums: no source's rows meet in one task.
RUNS = 4096


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``key, source_size`` with one row a source -> ``key, source_size, target, whole, extra``.

    Keys are ``s`` + source, or ``n`` for null. Weights repeat over the sources in code-point order, null last. The
    windows without a partition hold one row a source, not rows of the data.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("key") == "n", "key")))
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    ranked = ranked.withColumn("weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).withColumn("stop", F.col("source_size") * F.lit(float(max_epochs)))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("stop") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = ranked.withColumn("level", level).withColumn("stopped", F.col("level") > F.col("stop") / F.col("weight"))
    final = F.max(F.when(~F.col("stopped"), F.col("level"))).over(everything)
    filled = filled.withColumn("target", F.when(F.col("stopped"), F.col("stop")).otherwise(F.least(F.col("stop"), final * F.col("weight"))))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    return filled.withColumn("whole", whole).select("key", "source_size", "target", "whole", F.rint(F.col("target") - F.col("whole") * F.col("source_size")).cast("long").alias("extra"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2.0, seed: int = 7, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, ``size``, ``source_size``, ``target``, ``whole``, ``part``, ``taken`` and ``carry``.

    ``taken = whole * size + part`` words. Null text has size 0 and takes nothing; null sources are a source; rows that
    repeat each count; null ids take part like others; no rows give no rows. Columns not named are ignored, whatever
    their names; carried columns are returned in a struct ``carried``. The seeded order is a hash of id and seed, so
    reruns agree. Rows of one source are spread over ``RUNS`` runs of the order, each summed before it is dealt out.
    """
    src = F.col(f"`{source_col}`")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.when(src.isNull(), "n").otherwise(F.concat(F.lit("s"), src)).alias("key"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long").alias("draw"),
        *([F.struct(*(f"`{c}`" for c in carry)).alias("carried")] if carry else []),
    ).withColumn("run", F.pmod("draw", F.lit(RUNS)).cast("int"))
    if not carry:
        rows = staged(rows)
    runs = staged(rows.groupBy("key", "run").agg(F.sum("size").alias("run_size")))
    aims = targets(runs.groupBy("key").agg(F.sum("run_size").alias("source_size")), weights, share, max_epochs)
    earlier = F.coalesce(F.sum("run_size").over(Window.partitionBy("key").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = runs.withColumn("start", earlier).drop("run_size").join(aims, "key")
    within = Window.partitionBy("key", "run").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(plan, ["key", "run"]).withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("at")))
    return placed.withColumn("part", part).select(F.col("id").alias(id_col), "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"), *(["carried"] if carry else []))


def materialise(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself, in the columns of ``docs``: a row for each whole repetition, and one for each part.

    A part that is shorter than its document holds its first words, joined by blanks, with ``length_col`` recomputed.
    """
    mixed = mix(docs, text_col=text_col, carry=docs.columns, **options)
    edge = (F.col("part") > 0) & (F.col("part") < F.col("size"))
    copies = F.col("whole") + F.when((F.col("part") > 0) & ~edge, 1).otherwise(0)
    rows = mixed.select("carried", "size", "part", F.explode(F.filter(F.sequence(F.lit(0), (copies + edge.cast("long")).cast("int")), lambda i: i > 0)).alias("copy"), copies.alias("copies"))
    cut = F.col("copy") > F.col("copies")
    text = F.when(cut, F.array_join(F.slice(F.regexp_extract_all(F.col(f"carried.`{text_col}`"), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")).otherwise(F.col(f"carried.`{text_col}`"))
    rows = rows.withColumn("new_text", text)
    out = {text_col: F.col("new_text")}
    if length_col in docs.columns:
        out[length_col] = F.when(cut, F.char_length("new_text").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"carried.`{length_col}`"))
    return rows.select(*(out.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns))
