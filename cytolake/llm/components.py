"""Connected components by label propagation with pointer jumping, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spent


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, comp) for every id that a link names; comp is the smallest id that can be reached.

    Each round takes the smallest label among neighbours, then that label's own label, so the rounds grow with the
    logarithm of the longest path. Labels are minima, so a hot id is combined before the shuffle.
    """
    both = links.select(F.col(a).alias("id"), F.col(b).alias("to")).filter("id <> to")
    both = cut(both.unionByName(both.select(F.col("to").alias("id"), F.col("id").alias("to"))).distinct())
    labels = held = cut(both.groupBy("id").agg(F.min("to").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), "comp"), "to").groupBy("id").agg(F.min("comp").alias("m"))
        stepped = labels.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        stepped = cut(stepped.join(jump, "comp", "left").select("id", "was", F.least("comp", F.coalesce("further", "comp")).alias("comp")))
        spent(held)
        done = stepped.filter("comp <> was").isEmpty()
        labels, held = stepped.select("id", "comp"), stepped
        if done:
            spent(both)
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) for every id of ``labels``, after more links between ids of it; only what they change is worked on."""
    comp = lambda side: labels.select(F.col("id").alias(side), F.col("comp").alias("_" + side))
    between = cut(links.join(comp("a"), "a").join(comp("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).filter("a <> b"))
    if between.isEmpty():
        spent(between)
        return cut(labels)
    change = components(between).select(F.col("id").alias("comp"), F.col("comp").alias("_new"))
    spent(between)
    return cut(labels.join(change, "comp", "left").select("id", F.coalesce("_new", "comp").alias("comp")))
