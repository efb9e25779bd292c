"""Grouped summaries by category, store, hour, weekday, month, discount and payment method."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.columns import (
    floor_bracket, growth_direction, mean_where, member_band, month_is_holiday, percent, ratio,
)
from demandgrid.operators.facts import known
from demandgrid.operators.quantiles import attach
from demandgrid.operators.ranking import keep_top_groups, share_of_total


def _units(*names: str) -> list:
    measures = {
        "units": F.sum("units_sold"),
        "mean_units": F.avg("units_sold"),
        "std_units": F.stddev_samp("units_sold"),
        "min_units": F.min("units_sold"),
        "max_units": F.max("units_sold"),
        "rows": F.count("units_sold"),
    }
    return [measures[name].alias(name) for name in names]


def units_by(df: DataFrame, keys: str | Sequence[str], *measures: str) -> DataFrame:
    """Named unit measures by one or more keys; rows with an unknown key are left out."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return known(df, *keys).groupBy(keys).agg(*_units(*measures))


def category_summary(fact: DataFrame) -> DataFrame:
    return units_by(fact, "category", "units", "mean_units", "std_units", "rows").orderBy(F.desc("units"), "category")


def top_category_profile(fact: DataFrame, axis: str, k: int = 4, by_rows: bool = False) -> DataFrame:
    """Units, mean and rows along ``axis`` for the k categories with the most units (or rows)."""
    grouped = units_by(fact, ["category", axis], "units", "rows")
    kept = keep_top_groups(grouped, "category", F.col("rows" if by_rows else "units"), k)
    return kept.withColumn("mean_units", F.col("units") / F.col("rows"))


def flag_means(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Mean units with and without each flag: (flag, flag_value, mean_units, rows), in one pass.

    Rows are combined over all flags before the flags are unfolded.
    """
    combined = df.groupBy(*flags).agg(*_units("units", "rows"))
    pairs = ", ".join(f"'{flag}', {flag}" for flag in flags)
    long = combined.selectExpr("units", "rows", f"stack({len(flags)}, {pairs}) AS (flag, flag_value)")
    return (
        known(long, "flag_value")
        .groupBy("flag", "flag_value")
        .agg((F.sum("units") / F.sum("rows")).alias("mean_units"), F.sum("rows").alias("rows"))
    )


def bool_split(df: DataFrame, flag: str) -> DataFrame:
    """The rows with and without a flag, summarised side by side."""
    return known(df, flag).groupBy(flag).agg(*_units("rows", "units"))


def category_share(grid: DataFrame) -> DataFrame:
    return share_of_total(units_by(grid, "category", "units"), "units")


def hourly_revenue_volume(fact: DataFrame) -> DataFrame:
    return known(fact, "hour").groupBy("hour").agg(
        F.sum("revenue").alias("revenue"), F.sum("units_sold").alias("units"), F.avg("revenue").alias("mean_revenue")
    )


def discount_value_effect(fact: DataFrame) -> DataFrame:
    return units_by(fact, "discount_applied", "mean_units", "rows")


def discount_bracket_effect(fact: DataFrame) -> DataFrame:
    return units_by(fact.withColumn("bracket", floor_bracket(F.col("discount_applied"))), "bracket", "mean_units")


def value_counts_of(df: DataFrame, column: str) -> DataFrame:
    """How often each known value of a dimension column occurs, most frequent first."""
    return known(df, column).groupBy(column).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), column)


def payment_mix(order: DataFrame) -> DataFrame:
    counts = known(order, "payment_method").groupBy("payment_method").agg(F.count("*").alias("orders"))
    return share_of_total(counts, "orders")


def payment_revenue(transaction: DataFrame, order: DataFrame) -> DataFrame:
    lines = transaction.select("order_id", "revenue").join(order.select("order_id", "payment_method"), "order_id")
    return known(lines, "payment_method").groupBy("payment_method").agg(
        F.sum("revenue").alias("revenue"), F.avg("revenue").alias("mean_revenue")
    )


def orders_by_hour(order: DataFrame) -> DataFrame:
    return known(order, "hour").groupBy("hour").agg(F.count("*").alias("orders")).orderBy("hour")


def member_mix(order: DataFrame) -> DataFrame:
    """Orders of members and walk-ins with their share."""
    counts = order.groupBy(F.col("customer_id").isNotNull().alias("is_member")).agg(F.count("*").alias("orders"))
    return share_of_total(counts, "orders")


def member_revenue(transaction: DataFrame, order: DataFrame) -> DataFrame:
    """Revenue of members and walk-ins in one pass over the lines."""
    orders = order.select("order_id", F.col("customer_id").isNotNull().alias("is_member"))
    lines = transaction.select("order_id", "revenue").join(orders, "order_id")
    return lines.groupBy("is_member").agg(F.sum("revenue").alias("revenue"), F.count("*").alias("lines"))


def lines_of_orders(transaction: DataFrame, orders: DataFrame) -> DataFrame:
    """The order lines belonging to a set of orders."""
    return transaction.join(orders.select("order_id"), "order_id", "left_semi")


def revenue_by(fact: DataFrame, key: str) -> DataFrame:
    return known(fact, key).groupBy(key).agg(F.sum("revenue").alias("revenue")).orderBy(F.desc("revenue"), key)


def store_metrics(fact: DataFrame) -> DataFrame:
    return known(fact, "store_id").groupBy("store_id").agg(
        F.avg("units_sold").alias("mean_units"),
        F.avg("revenue").alias("mean_revenue"),
        F.count_distinct("order_id").alias("transactions"),
    )


def store_activity(fact: DataFrame) -> DataFrame:
    """Order lines and active hours; lines are combined per hour before hours are counted."""
    per_hour = known(fact, "store_id").groupBy("store_id", "hour").agg(F.count("order_id").alias("lines"))
    return per_hour.groupBy("store_id").agg(F.sum("lines").alias("orders"), F.count("hour").alias("hours_active"))


def store_efficiency(fact: DataFrame) -> DataFrame:
    totals = known(fact, "store_id").groupBy("store_id").agg(
        F.sum("revenue").alias("revenue"), F.count_distinct("order_id").alias("orders")
    )
    return totals.withColumn("revenue_per_order", ratio(F.col("revenue"), F.col("orders")))


def store_profitability(fact: DataFrame, store: DataFrame) -> DataFrame:
    """Revenue, units and distinct members per store, with revenue per member."""
    totals = known(fact, "store_id").groupBy("store_id").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("units_sold").alias("units"),
        F.count_distinct("customer_id").alias("customers"),
    )
    return totals.withColumn("revenue_per_customer", ratio(F.col("revenue"), F.col("customers"))).join(
        store.select("store_id", "neighborhood_type"), "store_id"
    )


def store_variety(target: DataFrame) -> DataFrame:
    return known(target, "store_id").groupBy("store_id").agg(F.count_distinct("category").alias("categories"))


def demand_volatility(daily_store: DataFrame) -> DataFrame:
    """Spread, mean and coefficient of variation of each store's daily units."""
    spread = units_by(daily_store, "store_id", "std_units", "mean_units")
    return spread.withColumn("cv", ratio(F.col("std_units"), F.col("mean_units")))


def daily_revenue(fact: DataFrame) -> DataFrame:
    return known(fact, "date").groupBy("date").agg(F.sum("revenue").alias("revenue"))


def revenue_volatility_month(fact: DataFrame) -> DataFrame:
    return daily_revenue(fact).groupBy(F.month("date").alias("month")).agg(F.stddev_samp("revenue").alias("std_revenue"))


def weekday_weekend_totals(fact: DataFrame) -> DataFrame:
    return known(fact, "is_weekend").groupBy("is_weekend").agg(
        F.sum("revenue").alias("revenue"), F.count("*").alias("lines")
    )


def weekend_holiday_interaction(target: DataFrame) -> DataFrame:
    return units_by(target, ["is_weekend", "is_holiday"], "mean_units")


def weekend_holiday_matrix(target: DataFrame) -> DataFrame:
    """The same means with one column per holiday value; NULL where a combination never occurred."""
    return known(target, "is_weekend", "is_holiday").groupBy("is_weekend").agg(
        mean_where(~F.col("is_holiday"), F.col("units_sold")).alias("regular"),
        mean_where(F.col("is_holiday"), F.col("units_sold")).alias("holiday"),
    )


def discount_by_category(fact: DataFrame) -> DataFrame:
    given = "discount_applied"
    return (
        known(fact, "category")
        .groupBy("category")
        .agg(
            F.avg(given).alias("mean_discount"), F.max(given).alias("max_discount"),
            F.min(given).alias("min_discount"), F.count(given).alias("rows"),
        )
        .orderBy(F.desc("mean_discount"), "category")
    )


def discount_volume_lift(transaction: DataFrame, margin: float = 100.0, discounted_margin: float = 50.0) -> DataFrame:
    """Mean units with and without discount, and what each would earn per line under assumed unit margins."""
    given, units = F.col("discount_applied"), F.col("units_sold")
    means = transaction.agg(
        mean_where(given == 0, units).alias("units_no_discount"), mean_where(given > 0, units).alias("units_discount")
    )
    return means.withColumns(
        {
            "margin_no_discount": F.col("units_no_discount") * margin,
            "margin_discount": F.col("units_discount") * discounted_margin,
        }
    )


def product_mix(fact: DataFrame) -> DataFrame:
    """Units, revenue and lines per category in whole numbers, with average price and both shares."""
    totals = known(fact, "category").groupBy("category").agg(
        F.round(F.sum("units_sold")).alias("units"),
        F.round(F.sum("revenue")).alias("revenue"),
        F.count("order_id").alias("lines"),
    )
    priced = totals.withColumn("avg_price", ratio(F.col("revenue"), F.col("units")))
    return share_of_total(share_of_total(priced, "units", "units_pct"), "revenue", "revenue_pct")


def weekday_revenue(fact: DataFrame) -> DataFrame:
    return known(fact, "weekday").groupBy("weekday").agg(
        F.avg("revenue").alias("mean_revenue"), F.count("order_id").alias("lines")
    )


def month_revenue(fact: DataFrame) -> DataFrame:
    return known(fact, "month").groupBy("month").agg(
        F.avg("revenue").alias("mean_revenue"), F.sum("revenue").alias("revenue")
    )


def kpi_scorecard(fact: DataFrame, order: DataFrame, split_month: int = 9) -> DataFrame:
    """Headline figures in one row; the facts are read once, combined per day."""
    days = fact.groupBy("date").agg(
        F.sum("revenue").alias("revenue"), F.sum("units_sold").alias("units"), F.count("revenue").alias("lines")
    )
    late = F.month("date") > split_month
    revenue = F.col("revenue")
    early_sum, late_sum = F.sum(F.when(~late, revenue)), F.sum(F.when(late, revenue))
    totals = days.agg(
        F.sum("revenue").alias("total_revenue"),
        F.avg("revenue").alias("mean_daily_revenue"),
        F.sum("units").alias("total_units"),
        ratio(F.sum("revenue"), F.sum("lines")).alias("mean_line_revenue"),
        percent(late_sum - early_sum, early_sum).alias("growth_pct"),
    )
    members = order.agg(percent(F.count("customer_id"), F.count("*")).alias("member_pct"))
    return attach(totals, members).withColumns(
        {"member_band": member_band(F.col("member_pct")), "direction": growth_direction(F.col("growth_pct"))}
    )


def holiday_period_impact(fact: DataFrame) -> DataFrame:
    in_period = month_is_holiday(F.col("date"))
    return fact.agg(
        mean_where(~in_period, F.col("revenue")).alias("regular_mean"),
        mean_where(in_period, F.col("revenue")).alias("holiday_mean"),
    )


def data_readiness(target: DataFrame, store: DataFrame, product: DataFrame) -> DataFrame:
    """Percent of the expected cells (stores x categories x days of the span), stores, categories and days present in the target."""
    present = target.agg(
        F.count("*").alias("rows"), F.count_distinct("store_id").alias("stores"), F.count_distinct("category").alias("categories"),
        F.count_distinct("date").alias("days"), (F.date_diff(F.max("date"), F.min("date")) + 1).alias("span"),
    )
    present = attach(present, store.agg(F.count_distinct("store_id").alias("all_stores")))
    present = attach(present, product.agg(F.count_distinct("category").alias("all_categories")))
    cells = F.col("all_stores").cast("double") * F.col("all_categories") * F.col("span")
    return present.select(
        percent(F.col("rows"), cells).alias("data_coverage"),
        percent(F.col("stores"), F.col("all_stores")).alias("store_coverage"),
        percent(F.col("categories"), F.col("all_categories")).alias("category_coverage"),
        percent(F.col("days"), F.col("span")).alias("date_range"),
    )


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """(column, value) for every known value of the given columns."""
    names = ", ".join(f"'{c}', CAST({c} AS STRING)" for c in columns)
    combined = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    return combined.selectExpr(f"stack({len(columns)}, {names}) AS (column, value)").where("value IS NOT NULL").distinct()


def store_means(df: DataFrame) -> DataFrame:
    """Total and mean daily units per store, greatest first."""
    return units_by(df, "store_id", "units", "mean_units").orderBy(F.desc("mean_units"), "store_id")


def neighborhood_of_stores(means: DataFrame, store: DataFrame) -> DataFrame:
    """Store means with the store's attributes."""
    return means.join(store, "store_id")


def attribute_bar(store_sales: DataFrame, attribute: str = "neighborhood_type") -> DataFrame:
    """Mean of store means per attribute value."""
    return known(store_sales, attribute).groupBy(attribute).agg(
        F.avg("mean_units").alias("mean_units"), F.count("*").alias("stores")
    )


def poisson_edges(bits: int = 32) -> list[int]:
    """The draws of ``bits`` bits from which on a Poisson variable with mean 1 is 1, 2, 3 and so on, as far as the bits can tell."""
    edges, mass, below = [], math.exp(-1), 0.0
    while (edge := math.floor((below := below + mass) * 2**bits)) < 2**bits - 1:
        edges.append(edge)
        mass /= len(edges)
    return edges


def attribute_bar_interval(
    store_sales: DataFrame,
    attribute: str = "neighborhood_type",
    replicates: int = 1000,
    seed: int = 17,
    level: float = 0.95,
) -> DataFrame:
    """Bootstrap confidence interval of :func:`attribute_bar`.

    A Poisson bootstrap: in each replicate a store counts as often as a draw from the Poisson distribution with mean 1 says, so a
    replicate is a pair of sums that merge in any order and stores need no numbers. The draw is a hash of (seed, replicate,
    store), so a rerun after a lost executor draws the same. A replicate that draws no store has no mean.
    """
    runs = F.sequence(F.lit(1), F.lit(replicates))
    stores = known(store_sales, attribute, "mean_units").select(attribute, "store_id", "mean_units", F.explode(runs).alias("replicate"))
    spot = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("replicate").cast("string"), F.col("store_id").cast("string")).cast("binary"))
    spot = F.conv(F.substring(spot, 1, 8), 16, 10).cast("long")
    times = reduce(Column.__add__, [(spot >= F.lit(edge)).cast("int") for edge in poisson_edges()])
    drawn = stores.withColumn("times", times).groupBy(attribute, "replicate")
    means = drawn.agg(F.try_divide(F.sum(F.col("times") * F.col("mean_units")), F.sum("times")).alias("mean"))
    tail = (1 - level) / 2
    interval = means.groupBy(attribute).agg(
        F.percentile("mean", tail).alias("ci_lo"), F.percentile("mean", 1 - tail).alias("ci_hi")
    )
    return attribute_bar(store_sales, attribute).join(interval, attribute)
