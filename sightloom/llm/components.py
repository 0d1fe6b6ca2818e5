"""Connected components by hooking roots to smaller roots and pointer jumping, all in equi-joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightloom.llm.common import Stashes


def merge(labels: DataFrame, edges: DataFrame, tables: Stashes, name: str = "labels") -> DataFrame:
    """labels (node, comp) after the components at both ends of each edge (a, b) have become one.

    comp is the smallest node of its component, before and after. Every round hooks each root that has a smaller
    neighbour; rounds end when no edge joins two components.
    """
    one, two = labels.select(F.col("node").alias("a"), F.col("comp").alias("u")), labels.select(F.col("node").alias("b"), F.col("comp").alias("v"))
    links = tables.put("links", edges.join(one, "a").join(two, "b").filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if links.isEmpty():
        return labels
    roots = tables.put("roots", links.select("u").union(links.select("v")).distinct().select("u", F.col("u").alias("top")))
    while not links.isEmpty():
        up = links.groupBy("u").agg(F.min("v").alias("top"))
        up = tables.put("up", up)
        while True:
            then = up.select(F.col("u").alias("top"), F.col("top").alias("next"))
            further = up.join(then, "top").select("u", F.col("next").alias("new"))
            if further.isEmpty():
                break
            up = tables.put("up", up.join(further, "u", "left").select("u", F.coalesce("new", "top").alias("top")))
        roots = tables.put("roots", roots.join(up.select(F.col("u").alias("top"), F.col("top").alias("new")), "top", "left").select("u", F.coalesce("new", "top").alias("top")))
        a = up.select("u", F.col("top").alias("cu"))
        b = up.select(F.col("u").alias("v"), F.col("top").alias("cv"))
        moved = links.join(a, "u", "left").join(b, "v", "left").select(F.coalesce("cu", "u").alias("x"), F.coalesce("cv", "v").alias("y"))
        links = tables.put("links", moved.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())
    new = roots.select(F.col("u").alias("comp"), F.col("top").alias("new"))
    return tables.put(name, labels.join(new, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp")))
