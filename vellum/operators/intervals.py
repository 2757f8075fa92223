"""Algebra of half-open integer intervals [start, end) within the groups of a key.

Every operator is a window or an aggregate over the key, so the chain merge, complement, destinations
shuffles once. A key's intervals are one session's; where a key can be hot, merge first by a finer key:
merging is associative (``merge(merge(a) ∪ merge(b)) = merge(a ∪ b)``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intersects(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a < d) & (c < b)


def touches(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a <= d) & (c <= b)


def contains(a: Column, b: Column, x: Column) -> Column:
    return (a <= x) & (x < b)


def overlap(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.greatest(F.lit(0), F.least(b, d) - F.greatest(a, c))


def padded(start: Column, end: Column, padding: Column | int, low: Column, high: Column) -> tuple[Column, Column]:
    """Grown at both ends within bounds; never inverted."""
    s = F.greatest(start - padding, low)
    return s, F.greatest(F.least(end + padding, high), s)


def merge(rows: DataFrame, key: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and abutting intervals as one; empty ones are dropped."""
    w = Window.partitionBy(*key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.where(F.col(end) > F.col(start)).select(*key, start, end, F.coalesce(F.col(start) > before, F.lit(True)).cast("int").alias("__new"))
    islands = marked.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*key, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def complement(merged: DataFrame, bounds: DataFrame, key: Sequence[str], start: str = "start", end: str = "end", low: str = "low", high: str = "high") -> DataFrame:
    """The gaps that merged intervals leave in each key's [low, high); a key without intervals is one gap."""
    clipped = bounds.select(*key, low, high).join(merged, [*key], "left")
    s, e = F.greatest(start, low), F.least(end, high)
    inside = F.col(start).isNotNull() & (e > s)
    w = Window.partitionBy(*key).orderBy(F.col("__s").asc_nulls_last())
    rows = clipped.select(*key, low, high, F.when(inside, s).alias("__s"), F.when(inside, e).alias("__e"))
    last = F.coalesce(F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col(low))
    gaps = rows.select(*key, last.alias("__from"), F.coalesce("__s", high).alias("__to"), "__e", high, F.lead(F.lit(1)).over(w).isNull().alias("__last"))
    parts = F.array(F.struct(F.col("__from").alias(start), F.col("__to").alias(end)), F.struct(F.when(F.col("__last"), F.greatest("__from", "__e")).alias(start), F.col(high).alias(end)))
    return gaps.select(*key, F.explode(parts).alias("g")).select(*key, "g.*").where(F.col(end) > F.col(start)).distinct()


def destinations(rows: DataFrame, key: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Where each retained interval lies once they are put one after the other: index, to_start, to_end."""
    w = Window.partitionBy(*key).orderBy(start)
    size = F.col(end) - F.col(start)
    stop = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"index": F.row_number().over(w) - 1, "to_start": stop - size, "to_end": stop})


def total_length(rows: DataFrame, key: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    return rows.groupBy(*key).agg(F.sum(F.col(end) - F.col(start)).alias("length"))


def overlap_lengths(left: DataFrame, right: DataFrame, key: Sequence[str], width: int, start: str = "start", end: str = "end") -> DataFrame:
    """Per interval of ``left`` the length that the intervals of ``right`` (merged, in the same key) cover.

    Both sides are cut into cells of ``width``, so the join is on the key and the cell, not on a range;
    of a pair that meets in several cells each cell counts its own part.
    """
    cell = lambda s, e: F.explode(F.sequence(F.floor(s / width), F.floor((e - 1) / width)))
    a = left.select(*key, start, end).distinct().where(F.col(end) > F.col(start)).withColumn("__cell", cell(F.col(start), F.col(end)))
    b = right.where(F.col(end) > F.col(start)).select(*key, F.col(start).alias("__s"), F.col(end).alias("__e"), cell(F.col(start), F.col(end)).alias("__cell"))
    low = F.greatest(F.col(start), F.col("__cell") * width)
    high = F.least(F.col(end), (F.col("__cell") + 1) * width)
    met = a.join(b, [*key, "__cell"], "left").select(*key, start, end, F.when(F.col("__s").isNotNull(), overlap(low, high, F.col("__s"), F.col("__e"))).otherwise(0).alias("__o"))  # greatest and least skip nulls
    return met.groupBy(*key, start, end).agg(F.sum("__o").cast("long").alias("covered"))
