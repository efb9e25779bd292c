"""Joined sales facts, the daily units target and its zero-filled grid.

No join carries a broadcast hint. Dimension sides are broadcast by Spark only when their
measured size is under the session's threshold, otherwise the join is a shuffled one that
adaptive execution can split on skewed keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.calendar import day_name, weekday
from demandgrid.functions.columns import all_known
from demandgrid.session import spread

CELL = ["store_id", "category", "date"]
ORDER_COLUMNS = ["order_id", "store_id", "date", "hour", "customer_id", "payment_method"]
STORE_COLUMNS = ["store_id", "neighborhood_type", "seating_capacity", "staff_count", "has_drive_through"]
CALENDAR_COLUMNS = ["date", "is_weekend", "is_holiday", "is_payday", "is_school_break", "is_rainy_season"]


def known(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are all present: a grouping drops unknown keys.

    Plain IS NOT NULL conditions, which Spark pushes into the scan and also infers from joins,
    so that the same relation used twice in a query keeps one shape and its shuffle is reused.
    """
    return df.where(all_known(*keys))


def master_fact(
    transaction: DataFrame, order: DataFrame, product: DataFrame, store: DataFrame, date_dim: DataFrame
) -> DataFrame:
    """Every order line with its order, product, store and calendar day."""
    return (
        transaction.join(order.select(ORDER_COLUMNS), "order_id")
        .join(product.select("product_id", "category", "base_price"), "product_id")
        .join(store.select(STORE_COLUMNS), "store_id")
        .join(date_dim.select(CALENDAR_COLUMNS), "date")
        .withColumns(
            {
                "day_of_week": day_name(F.col("date")),
                "month": F.month("date"),
                "week": F.weekofyear("date"),
                "weekday": weekday(F.col("date")),
            }
        )
    )


def hourly_fact(transaction: DataFrame, order: DataFrame, store: DataFrame) -> DataFrame:
    """Order lines with hour, weekday and neighbourhood only."""
    return (
        transaction.join(order.select("order_id", "store_id", "date", "hour"), "order_id")
        .join(store.select("store_id", "neighborhood_type"), "store_id")
        .withColumns({"day_of_week": day_name(F.col("date")), "weekday": weekday(F.col("date"))})
    )


def daily_target(transaction: DataFrame, order: DataFrame, product: DataFrame) -> DataFrame:
    """Units sold by store, category and day, for the cells that had sales."""
    lines = transaction.join(order.select("order_id", "store_id", "date"), "order_id").join(
        product.select("product_id", "category"), "product_id"
    )
    return known(lines, *CELL).groupBy(CELL).agg(F.sum("units_sold").alias("units_sold"))


def enrich_target(target: DataFrame, date_dim: DataFrame, store: DataFrame) -> DataFrame:
    """The daily target with calendar flags, neighbourhood, month and weekday."""
    return (
        target.join(date_dim.select(CALENDAR_COLUMNS), "date")
        .join(store.select("store_id", "neighborhood_type"), "store_id")
        .withColumns({"month": F.month("date"), "weekday": weekday(F.col("date"))})
    )


def grid_keys(target: DataFrame) -> DataFrame:
    """Every store x category x day between the first and last day of ``target``.

    The product is built by exploding, not by joining: every store stays a row of its own, unfolds the
    categories of one aggregate row (a handful, with the date span), and the pairs, spread over the cluster,
    unfold their days. The counts of units keep both inputs identical to the target itself, so
    that the target's shuffle is run once and read wherever the target is used in a query.
    """
    span = target.agg(
        F.collect_set("category").alias("categories"),
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        F.count("units_sold").alias("cells"),
    ).where(F.col("cells") > 0)
    stores = target.groupBy("store_id").agg(F.count("units_sold").alias("cells")).where(F.col("cells") >= 0)
    row = span.select(F.struct("categories", "first", "last").alias("row")).scalar()
    pairs = stores.select("store_id", row.alias("span")).select(
        "store_id", F.explode("span.categories").alias("category"), "span.first", "span.last"
    )
    return pairs.repartition(spread(target.sparkSession), "store_id", "category").select(
        "store_id", "category", F.explode(F.sequence("first", "last")).alias("date")
    )


def full_grid(target: DataFrame) -> DataFrame:
    """The target on every cell of the key grid, zero where nothing was sold."""
    return (
        grid_keys(target)
        .join(target, CELL, "left")
        .withColumn("units_sold", F.coalesce("units_sold", F.lit(0.0)))
    )


def grid_zero_rate(grid: DataFrame) -> DataFrame:
    return grid.agg(
        F.count("*").alias("cells"),
        F.count_if(F.col("units_sold") == 0).alias("zero_cells"),
        F.avg((F.col("units_sold") == 0).cast("double")).alias("zero_rate"),
    )


def left_join_calendar(grid: DataFrame, date_dim: DataFrame) -> DataFrame:
    return grid.join(date_dim, "date", "left")


def left_join_flag(df: DataFrame, flags: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Carries a boolean from ``flags`` (unique on ``keys``); cells without a match get false."""
    return df.join(flags.select(*keys, flag), keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def within_calendar(spans: DataFrame, date_dim: DataFrame, first: str, last: str) -> DataFrame:
    """Closed intervals of days cut to the span of the calendar; those outside it are left out.

    An interval without a real end then costs as many days as the calendar has; an empty calendar leaves none.
    """
    ends = date_dim.agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    cut = spans.withColumn("_calendar", ends.select(F.struct("_first", "_last")).scalar()).withColumns({
        first: F.greatest(first, "_calendar._first"), last: F.least(last, "_calendar._last"),
    })
    return cut.where(all_known("_calendar._first") & (F.col(first) <= F.col(last))).drop("_calendar")


def promo_daily_long(promotion: DataFrame, product: DataFrame, date_dim: DataFrame) -> DataFrame:
    """One row per promotion and day of its closed interval, with the product's category.

    Intervals are cut to the days of the calendar ``date_dim``: on other days nothing was or could be sold.
    """
    spans = within_calendar(promotion.where(F.col("start_date") <= F.col("end_date")), date_dim, "start_date", "end_date")
    days = spans.withColumn("date", F.explode(F.sequence("start_date", "end_date")))
    return days.join(product.select("product_id", "category"), "product_id", "left").select(
        "store_id", "category", "date", "product_id", "promo_type", "discount_pct"
    )


def promo_flag(promo_days: DataFrame) -> DataFrame:
    """Active promotions and their mean discount by store, category and day."""
    return (
        known(promo_days, *CELL)
        .groupBy(CELL)
        .agg(F.count("discount_pct").alias("promos"), F.avg("discount_pct").alias("avg_discount"))
    )


def stockout_store_day(inventory: DataFrame) -> DataFrame:
    return (
        known(inventory, "store_id", "date")
        .groupBy("store_id", "date")
        .agg(F.bool_or("is_stockout").alias("any_stockout"))
    )


def stockout_store_cat_day(inventory: DataFrame, product: DataFrame) -> DataFrame:
    stocked = inventory.join(product.select("product_id", "category"), "product_id")
    return known(stocked, *CELL).groupBy(CELL).agg(F.bool_or("is_stockout").alias("has_stockout"))


def daily_total(df: DataFrame, *extra_keys: str) -> DataFrame:
    keys = ["date", *extra_keys]
    return known(df, *keys).groupBy(keys).agg(F.sum("units_sold").alias("units_sold"))


def daily_store(target: DataFrame) -> DataFrame:
    return daily_total(target, "store_id")


def baskets(transaction: DataFrame) -> DataFrame:
    """Units and lines of each order."""
    return (
        known(transaction, "order_id")
        .groupBy("order_id")
        .agg(F.sum("units_sold").alias("units"), F.count("product_id").alias("lines"))
    )


def member_frequency(order: DataFrame) -> DataFrame:
    return known(order, "customer_id").groupBy("customer_id").agg(F.count("order_id").alias("orders"))
