"""Exact ranks and quantiles that no single task has to hold.

A column is first reduced to its distinct values and their counts, combined before the
shuffle, so a hot group or a hot value costs one row. A mergeable quantile sketch over these
rows places the edges of value slots where the data are, however narrow the band they fill;
the sketch decides nothing else. Slot totals give the ranks at which slots begin, and only the
slots that hold a wanted rank are ordered inside. No group is ever gathered whole.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.columns import all_known, known_number

# Slots over all groups together; a power of two, so that halving finds a value's slot in eight steps.
SLOTS = 256


def value_counts(df: DataFrame, column: str | Column, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., value, n): the distinct non-null values of a column and how often each occurs."""
    value = F.col(column) if isinstance(column, str) else column
    count = F.sum(weight) if weight else F.count("*")
    return (
        df.withColumn("value", known_number(value.cast("double")))
        .where(all_known(*by, "value"))
        .groupBy(*by, "value")
        .agg(count.alias("n"))
    )


def attach(df: DataFrame, stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds the columns of ``stats``: by key, or from its only row through a scalar subquery."""
    if by:
        return df.join(stats, list(by))
    row = stats.select(F.struct(*stats.columns).alias("row")).scalar()
    return df.withColumn("_row", row).select(*df.columns, *[F.col("_row")[c].alias(c) for c in stats.columns])


def aggregated(df: DataFrame, by: Sequence[str], *measures: Column) -> DataFrame:
    """Measures over grouped rows that are used elsewhere in the same query, too.

    The aggregate names every column of ``df``, so Spark prunes none and both uses read one shuffle, computed once.
    """
    every = F.max(F.struct(*[F.col(c) for c in df.columns])).alias("_every")
    kept = df.groupBy(*by).agg(*measures, every).where(F.col("_every").isNotNull())
    return kept.drop("_every")


def slotted(counts: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Adds ``slot``, the number of edges below the value, and ``edge``, the last of them (the first edge for slot 0).

    The edges are quantiles of all rows of ``counts`` by a sketch with an error of a tenth of a slot, so a slot of
    a group has about as many rows as all rows have per slot, at most. The sketch is a scalar subquery: used
    several times in a query it is run once (Spark's reuse of subqueries, on by default), so all uses see the same edges.
    """
    shares = F.lit(np.arange(1, slots) / slots)  # one literal, which plans faster than as many as there are edges
    sketch = F.percentile_approx("value", shares, 10 * slots).alias("edges")
    edges, value = F.col("_edges"), F.col("value")
    halves = F.lit(np.array([slots >> k for k in range(1, slots.bit_length())], np.int32))

    def narrowed(place: Column, half: Column) -> Column:
        return place + F.when(F.get(edges, place + half - 1) < value, half).otherwise(0)

    placed = counts.withColumn("_edges", aggregated(counts, (), sketch).scalar())
    slot = F.coalesce(F.aggregate(halves, F.lit(0), narrowed), F.lit(0))
    return placed.withColumn("slot", slot).select(
        *counts.columns, "slot", F.get(edges, F.greatest(F.col("slot") - 1, F.lit(0))).alias("edge")
    )


def slot_totals(placed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., slot, edge, slot_n, off, square, least, most, before, total, mean): one row per occupied slot of a group.

    ``off`` and ``square`` are sums of the distances from the slot's edge and of their squares, ``before`` the rank at
    which the slot begins, ``total`` and ``mean`` those of the group.
    """
    off = F.col("value") - F.col("edge")
    sums = placed.groupBy(*by, "slot", "edge").agg(
        F.sum("n").alias("slot_n"), F.sum(F.col("n") * off).alias("off"), F.sum(F.col("n") * off * off).alias("square"),
        F.min("value").alias("least"), F.max("value").alias("most"),
    )
    group = Window.partitionBy(*by)  # without keys: over the slots, whose number is fixed
    so_far = group.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("slot_n").over(group)
    return sums.withColumns({
        "before": F.sum("slot_n").over(so_far) - F.col("slot_n"),
        "total": total,
        "mean": F.sum(F.col("slot_n") * F.col("edge") + F.col("off")).over(group) / total,
    })


def rank_spans(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Each distinct value with the 0-based ranks it covers: ``first`` and ``last`` (closed) and the group's ``total``."""
    placed = slotted(counts)
    offsets = slot_totals(placed, by).select(*by, "slot", "before", "total")
    return _spans(placed.join(offsets, [*by, "slot"]), by).select(*by, "value", "n", "first", "last", "total")


def _spans(placed: DataFrame, by: Sequence[str]) -> DataFrame:
    in_slot = Window.partitionBy(*by, "slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("n").over(in_slot)
    return placed.withColumn("last", upto - 1).withColumn("first", F.col("last") + 1 - F.col("n"))


def _ranked(placed: DataFrame, totals: DataFrame, probabilities: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """(by..., <name>...): quantiles, from the slots that hold a rank they need."""
    position = {name: F.lit(float(p)) * (F.col("total") - 1) for name, p in probabilities.items()}
    ranks = F.array(*[end for place in position.values() for end in (F.floor(place), F.ceil(place))])
    begin, end = F.col("before"), F.col("before") + F.col("slot_n")
    needed = totals.where(F.exists(ranks, lambda r: (r >= begin) & (r < end))).select(*by, "slot", "before", "total")
    if by:
        rows = placed.join(needed, [*by, "slot"])
    else:  # a few slots, looked up in one row
        table = needed.agg(F.map_from_entries(F.collect_list(F.struct("slot", "before"))).alias("starts"), F.max("total").alias("total"))
        # the condition names the count too, so that it stays above the counts and their shuffle serves every branch of the query
        before = F.when(F.col("n") > 0, F.try_element_at("starts", "slot"))
        rows = attach(placed, table).withColumn("before", before).where(F.col("before").isNotNull())

    def value_at(rank: Column) -> Column:
        return F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("value")))

    def interpolated(place: Column, name: str) -> Column:
        low, high = value_at(F.floor(place)), value_at(F.ceil(place))
        return (low + (high - low) * F.max(place - F.floor(place))).alias(name)

    return _spans(rows, by).groupBy(*by).agg(*[interpolated(place, name) for name, place in position.items()])


def quantiles(counts: DataFrame, probabilities: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linearly interpolated quantiles, one column per name; one row per group."""
    placed = slotted(counts)
    return _ranked(placed, slot_totals(placed, by), probabilities, by)


def summary(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max of a column given its value counts."""
    placed = slotted(counts)
    totals = slot_totals(placed, by)
    n, to_mean = F.col("slot_n"), F.col("edge") - F.col("mean")
    spread = F.sum(F.col("square") + 2 * to_mean * F.col("off") + n * to_mean * to_mean)
    moments = totals.groupBy(*by).agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"),
        F.max("mean").alias("mean"),
        F.when(F.sum(n) > 1, F.sqrt(F.greatest(spread / (F.sum(n) - 1), F.lit(0.0)))).alias("std"),
        F.min("least").alias("min"),
        F.max("most").alias("max"),
    )
    quartiles = _ranked(placed, totals, {"q25": 0.25, "median": 0.5, "q75": 0.75}, by)
    return attach(moments, quartiles, by).select(*by, "count", "mean", "std", "min", "q25", "median", "q75", "max")
