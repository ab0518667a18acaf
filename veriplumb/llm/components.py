"""Connected components of a graph of links, as joins and grouped minima.

Each round every node with a smaller neighbour hooks onto its smallest one, pointers are doubled until they reach a root,
and the links are drawn anew between roots. Rounds are logarithmic in the size of a component; a hub's links meet only in
partial minima and in joins that Spark can split. Nothing is collected but counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_side, staged


def _roots(parents: DataFrame) -> DataFrame:
    """``node, parent`` with parents below their nodes -> ``node, root``, by pointer doubling."""
    at = staged(parents)
    while True:
        up = small_side(at.select(F.col("node").alias("parent"), F.col("parent").alias("next")))
        moved = staged(at.join(up, "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")))
        at = moved.select("node", "parent")
        if moved.filter("moved").isEmpty():
            return at.withColumnRenamed("parent", "root")


def components(links: DataFrame) -> DataFrame:
    """``u, v`` (longs) -> ``node, root`` for each node with a link to another; the root is the component's least node.

    Loops, nulls and repeated links are ignored; no links give no rows.
    """
    edges = staged(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    known = None
    while not edges.isEmpty():
        hooked = _roots(edges.groupBy("u").agg(F.min("v").alias("parent")).withColumnRenamed("u", "node"))
        to = small_side(hooked.select(F.col("node").alias("old"), "root"))
        moved = edges
        for end in ("u", "v"):
            moved = moved.join(to, moved[end] == to["old"], "left").withColumn(end, F.coalesce("root", end)).select("u", "v")
        if known is None:
            known = hooked
        else:
            now = known.join(to, known["root"] == to["old"], "left").select("node", F.coalesce(to["root"], known["root"]).alias("root"))
            known = staged(now.unionByName(hooked.join(known.select("node"), "node", "left_anti")))
        edges = staged(moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if known is None:
        return links.select(F.col("u").cast("long").alias("node"), F.col("v").cast("long").alias("root")).limit(0)
    roots = known.select(F.col("root").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return known.unionByName(roots.join(known.select("node"), "node", "left_anti"))
