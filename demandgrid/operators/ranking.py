"""Shares, cumulative shares, top and bottom lists, and quantile-based splits.

Windows without a partition key run here only over results already grouped to one row per
category, store, hour or basket size, never over order lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.columns import pareto_class, percent
from demandgrid.operators.quantiles import aggregated, attach, quantiles, summary, value_counts

def _total(value: str) -> Column:
    return F.sum(value).over(Window.partitionBy())


def share_of_total(grouped: DataFrame, value: str, name: str = "pct") -> DataFrame:
    """Percentage of the column's total, for a frame with one row per group."""
    return grouped.withColumn(name, percent(F.col(value), _total(value)))


def pareto_cumulative(grouped: DataFrame, key: str, value: str) -> DataFrame:
    """Running share of the total from the greatest group down, with its class."""
    down = Window.orderBy(F.desc(value), key).rowsBetween(Window.unboundedPreceding, 0)
    running = percent(F.sum(value).over(down), _total(value))
    return grouped.withColumn("cum_pct", running).withColumn("class", pareto_class(F.col("cum_pct")))


def top_k(grouped: DataFrame, key: str, value: str, k: int) -> DataFrame:
    return grouped.orderBy(F.desc(value), key).limit(k)


def bottom_k(grouped: DataFrame, key: str, value: str, k: int) -> DataFrame:
    return grouped.orderBy(value, key).limit(k)


def top_bottom_k(grouped: DataFrame, key: str, value: str, k: int) -> DataFrame:
    bottom = bottom_k(grouped, key, value, k).withColumn("side", F.lit("bottom"))
    return bottom.unionByName(top_k(grouped, key, value, k).withColumn("side", F.lit("top")))


def ranked(grouped: DataFrame, key: str, value: str) -> DataFrame:
    """Ascending position of each group."""
    return grouped.withColumn("rank", F.row_number().over(Window.orderBy(value, key)))


def keep_top_groups(grouped: DataFrame, key: str, weight: Column, k: int) -> DataFrame:
    """Rows of the k groups with the greatest total weight, of a frame already grouped by ``key`` and more.

    Totals per group first, the k greatest of them by a bounded heap per task, then a join back, one row a group. (A
    semi-join would be moved below the grouping.) Both uses of the grouped rows share one shuffle.
    """
    totals = aggregated(grouped, [key], F.sum(weight).alias("_total"))
    return grouped.join(top_k(totals, key, "_total", k).select(key), key).select(grouped.columns)


def hour_neighborhood_weekday(fact: DataFrame, complete: bool = False) -> DataFrame:
    """Five statistics of line units by hour, neighbourhood and weekday, with the candle body.

    ``complete`` adds the combinations that never occurred, with zero spread and NULL statistics.
    """
    by = ["hour", "neighborhood_type", "weekday"]
    counts = value_counts(fact, "units_sold", by)
    stats = summary(counts, by).select(*by, "mean", "median", "std", "min", "max")
    if complete:
        stats = _combinations(counts, by).join(stats, by, "left")
    body = F.greatest(F.col("std"), F.lit(1.0))
    return stats.withColumn("std", F.coalesce("std", F.lit(0.0))).withColumns(
        {"body_height": body, "body_bottom": F.col("median") - body / 2}
    )


def _combinations(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every hour x neighbourhood x weekday from the values seen (all seven weekdays)."""
    seen = counts.agg(F.collect_set("hour").alias("hours"), F.collect_set("neighborhood_type").alias("places"))
    return (
        seen.select(F.explode("hours").alias("hour"), "places")
        .select("hour", F.explode("places").alias("neighborhood_type"))
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("weekday"))
        .select(*by)
    )


def _with_quartiles(hourly: DataFrame, value: str) -> DataFrame:
    """Quartiles over hours of the day: at most 24 values, so one built-in aggregate holds them."""
    quartiles = hourly.agg(F.percentile(value, 0.25).alias("low"), F.percentile(value, 0.75).alias("high"))
    return attach(hourly, quartiles)


def workload_split(hourly: DataFrame, value: str = "units") -> DataFrame:
    """Units in peak hours (above the upper quartile of hours), off-peak (up to the lower) and the rest."""
    amount = F.col(value)
    kind = F.when(amount > F.col("high"), "peak").when(amount <= F.col("low"), "off_peak").otherwise("mid")
    classed = _with_quartiles(hourly, value).groupBy(kind.alias("class"))
    return classed.agg(F.sum(value).alias("units"), F.count("*").alias("hours"))


def peak_hours(hourly: DataFrame, value: str = "mean_revenue") -> DataFrame:
    """Hours flagged as peak when their value reaches the upper quartile of hours."""
    flagged = _with_quartiles(hourly, value)
    return flagged.withColumn("is_peak", F.col(value) >= F.col("high")).drop("low", "high")


def basket_segments(baskets: DataFrame) -> DataFrame:
    """Share of orders and of units in small and large baskets, and the medium remainder of orders.

    Baskets are first combined to (size, count). Small and large may overlap when the quartiles
    meet, so medium is what is left of 100 %.
    """
    sizes = value_counts(baskets, "units")
    cut = attach(sizes, quantiles(sizes, {"low": 0.25, "high": 0.75}))
    size, n = F.col("value"), F.col("n")
    small, large = size <= F.col("low"), size >= F.col("high")

    def part(condition: Column, amount: Column) -> Column:
        return percent(F.sum(F.when(condition, amount).otherwise(0)), F.sum(amount))

    row = cut.agg(
        part(small, n).alias("small_orders"), part(large, n).alias("large_orders"),
        part(small, n * size).alias("small_units"), part(large, n * size).alias("large_units"),
    )
    return row.selectExpr(
        "stack(3, 'small', small_orders, small_units, 'large', large_orders, large_units,"
        " 'medium', 100 - small_orders - large_orders, CAST(NULL AS DOUBLE)) AS (segment, pct_orders, pct_units)"
    )
