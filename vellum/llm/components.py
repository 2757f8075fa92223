"""Connected components of a table of links, by contraction to least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of a link (a, b): label is the smallest node that can be reached.

    Each round maps every node to the least of itself and its neighbours, moves the links along and
    drops those that became loops or repeats, so the tables shrink from round to round; the maps are
    chained backwards at the end. Names should be hashes: their random order keeps the rounds few. A
    hub's neighbours are reduced where they are before the shuffle. No links give an empty table.
    """
    edges = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    alone = links.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("label"))
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        least = edges.select(F.col("a").alias("node"), F.col("a").alias("near")).union(edges.select("b", "a"))
        maps.append(materialize(least.groupBy("node").agg(F.min("near").alias("label")), "labels"))
        to = lambda end: maps[-1].select(F.col("node").alias(end), F.col("label").alias(f"{end}_to"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        edges = materialize(moved.where("a < b").distinct(), "links")
    if not maps:
        return alone.distinct()
    out = maps.pop()
    while maps:
        later = out.select(F.col("node").alias("label"), F.col("label").alias("last"))
        out = materialize(maps.pop().join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label")), "labels")
    return out.union(alone.distinct().join(out, "node", "left_anti"))
