"""Promotion, local event and stockout effects.

The reports differ in what a flag means: anywhere on that day, in that store, or in that
store and category. Wherever a flag depends on the day only, the sales are combined per day
before the flag is joined, so that no raw row is shuffled on a calendar date.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.calendar import iso_year
from demandgrid.functions.columns import percent
from demandgrid.operators.facts import CELL, known, left_join_flag, within_calendar
from demandgrid.operators.quantiles import summary, value_counts
from demandgrid.operators.ranking import keep_top_groups, top_k

STORE_DAY = ["store_id", "date"]


def promo_dates(promotion: DataFrame, date_dim: DataFrame) -> DataFrame:
    """The days of the calendar on which any promotion ran."""
    return active_promos(promotion, date_dim).select("date")


def event_dates(local_event: DataFrame) -> DataFrame:
    return known(local_event, "date").select("date").distinct()


def event_store_days(local_event: DataFrame) -> DataFrame:
    return known(local_event, *STORE_DAY).select(*STORE_DAY).distinct()


def flag_rows(df: DataFrame, members: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Adds ``flag``: whether the row's keys occur in ``members``, which must be unique on them."""
    return left_join_flag(df, members.withColumn(flag, F.lit(True)), list(keys), flag)


def rows_on(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members, list(keys), "left_semi")


def rows_not_on(df: DataFrame, members: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(members, list(keys), "left_anti")


def active_promos(promotion: DataFrame, date_dim: DataFrame) -> DataFrame:
    """How many promotions run on each day of the calendar, for the days with any.

    A sweep over interval ends: +1 on the first day, -1 on the day after the last, combined per day before the shuffle, and a
    running sum over the days of change. However long an interval, it costs two rows, and only
    the days of the calendar are unfolded. The window holds one row per day of change.
    """
    spans = within_calendar(promotion.select("start_date", "end_date").where("start_date <= end_date"), date_dim, "start_date", "end_date")
    ends = F.array(F.struct(F.col("start_date").alias("date"), F.lit(1).alias("step")), F.struct(F.date_add("end_date", 1).alias("date"), F.lit(-1).alias("step")))
    steps = spans.select(F.explode(ends).alias("end")).groupBy("end.date").agg(F.sum("end.step").alias("step"))
    by_date = Window.orderBy("date")
    running = steps.select(
        "date", F.sum("step").over(by_date.rowsBetween(Window.unboundedPreceding, 0)).alias("promos"), F.lead("date").over(by_date).alias("until")
    )
    days = F.sequence(F.col("date"), F.date_sub("until", 1))
    return running.where("promos > 0").select(F.explode(days).alias("date"), "promos")


def effect(df: DataFrame, flag: str, value: str = "units_sold", by: Sequence[str] = ()) -> DataFrame:
    """Mean, exact median, sample deviation and rows of ``value`` with and without the flag."""
    keys = [*by, flag]
    stats = summary(value_counts(df, value, keys), keys)
    return stats.select(*keys, "mean", "median", "std", F.col("count").alias("rows"))


def day_flag_means(target: DataFrame, days: DataFrame, flag: str) -> DataFrame:
    """Mean target units with and without a flag that depends on the day only."""
    per_day = target.groupBy("date").agg(F.sum("units_sold").alias("units"), F.count("units_sold").alias("rows"))
    flagged = flag_rows(per_day, days, ["date"], flag)
    return flagged.groupBy(flag).agg((F.sum("units") / F.sum("rows")).alias("mean_units"), F.sum("rows").alias("rows"))


def category_flag_means(target: DataFrame, members: DataFrame, keys: Sequence[str], flag: str, k: int = 4) -> DataFrame:
    """Mean units by flag for the k categories with the most units, with each flag's share of the category's rows."""
    per_key = target.groupBy("category", *keys).agg(F.sum("units_sold").alias("units"), F.count("units_sold").alias("rows"))
    grouped = flag_rows(per_key, members, keys, flag).groupBy("category", flag).agg(
        F.sum("units").alias("units"), F.sum("rows").alias("rows")
    )
    kept = keep_top_groups(grouped, "category", F.col("units"), k)
    totals = kept.groupBy("category").agg(F.sum("rows").alias("all_rows"))
    return kept.join(totals, "category").select(
        "category", flag, (F.col("units") / F.col("rows")).alias("mean_units"), "rows",
        percent(F.col("rows"), F.col("all_rows")).alias("coverage_pct"),
    )


def day_flag_value_counts(target: DataFrame, days: DataFrame, flag: str) -> DataFrame:
    """Value counts of target units under a day flag, combined per day before the flag is joined."""
    per_day = target.groupBy("date", F.col("units_sold").alias("value")).agg(F.count("*").alias("n"))
    return flag_rows(per_day, days, ["date"], flag).groupBy(flag, "value").agg(F.sum("n").alias("n"))


def promo_daily_revenue(fact: DataFrame, promotion: DataFrame, date_dim: DataFrame) -> DataFrame:
    """Mean daily revenue of days with and without any promotion."""
    days = known(fact, "date").groupBy("date").agg(F.sum("revenue").alias("revenue"))
    flagged = flag_rows(days, promo_dates(promotion, date_dim), ["date"], "has_promo")
    return flagged.groupBy("has_promo").agg(F.avg("revenue").alias("mean_daily_revenue"), F.count("*").alias("days"))


def promo_cells(grid: DataFrame, flags: DataFrame) -> DataFrame:
    """The grid with whether a promotion ran in that store, category and day."""
    cells = flags.select(*CELL, (F.col("promos") > 0).alias("has_promo"))
    return left_join_flag(grid, cells, CELL, "has_promo")


def promo_type_effect(promo_days: DataFrame, grid: DataFrame) -> DataFrame:
    """Mean units over promotion days by promotion type; a cell counts once per promotion on it."""
    on_days = left_join_target(promo_days, grid)
    return known(on_days, "promo_type").groupBy("promo_type").agg(
        F.avg("units_sold").alias("mean_units"), F.count("*").alias("promo_days")
    ).orderBy(F.desc("mean_units"), "promo_type")


def left_join_target(promo_days: DataFrame, grid: DataFrame) -> DataFrame:
    return promo_days.join(grid, CELL, "left")


def event_cells(grid: DataFrame, local_event: DataFrame, dedupe: bool = True) -> DataFrame:
    """The grid with whether the store had an event that day.

    ``dedupe=False`` repeats a cell once per event of its store-day.
    """
    if dedupe:
        return flag_rows(grid, event_store_days(local_event), STORE_DAY, "has_event")
    events = known(local_event, *STORE_DAY).select(*STORE_DAY, F.lit(True).alias("has_event"))
    return left_join_flag(grid, events, STORE_DAY, "has_event")


def event_day_totals(fact: DataFrame, local_event: DataFrame) -> DataFrame:
    """Daily sums of the facts with whether any store had an event that day."""
    days = known(fact, "date").groupBy("date").agg(
        F.sum("revenue").alias("revenue"), F.sum("units_sold").alias("units"), F.count("revenue").alias("lines")
    )
    return flag_rows(days, event_dates(local_event), ["date"], "has_event")


def event_effect_date(fact: DataFrame, local_event: DataFrame) -> DataFrame:
    totals = event_day_totals(fact, local_event).groupBy("has_event").agg(
        F.sum("revenue").alias("revenue"), F.sum("units").alias("units"), F.sum("lines").alias("lines")
    )
    return totals.withColumns(
        {"mean_revenue": F.col("revenue") / F.col("lines"), "mean_units": F.col("units") / F.col("lines")}
    )


def event_lift(fact: DataFrame, local_event: DataFrame, revenue_share: float = 0.8) -> DataFrame:
    """Percent gain in mean line units on event days, and the revenue gain assumed from it."""
    with_event = F.col("has_event")

    def mean(condition):
        return F.sum(F.when(condition, F.col("units"))) / F.sum(F.when(condition, F.col("lines")))

    quiet, busy = mean(~with_event), mean(with_event)
    lift = event_day_totals(fact, local_event).agg(percent(busy - quiet, quiet).alias("unit_lift_pct"))
    return lift.withColumn("revenue_lift_pct", F.col("unit_lift_pct") * revenue_share)


def events_per_store(local_event: DataFrame, k: int = 10) -> DataFrame:
    counts = known(local_event, "store_id").groupBy("store_id").agg(F.count("*").alias("events"))
    return top_k(counts, "store_id", "events", k)


def stock_lines(fact: DataFrame, inventory: DataFrame, with_store: bool = False) -> DataFrame:
    """Line units by category, week and stock state, as weighted value counts.

    Without the store in the key, a line meets the inventory rows of every store holding the
    product that day and counts once for each. Both sides are combined per product and day
    first, so the repeats become weights ``n`` instead of rows. Lines without inventory are in
    stock. ``sold`` counts each line once, whatever it met.
    """
    keys = ["store_id", "product_id", "date"] if with_store else ["product_id", "date"]
    lines = known(fact, *keys).groupBy(*keys, "category", "units_sold").agg(F.count("*").alias("lines"))
    stock = known(inventory, *keys).groupBy(*keys).agg(
        F.count_if(F.coalesce("is_stockout", F.lit(False))).alias("out"), F.count("*").alias("held")
    )
    met = lines.join(stock, keys, "left").withColumns(
        {"out": F.coalesce("out", F.lit(0)), "held": F.coalesce("held", F.lit(1))}
    )
    states = met.selectExpr(
        "category", "weekofyear(date) AS week", "units_sold AS value",
        "stack(2, true, lines * out, 0L, false, lines * (held - out), lines) AS (is_stockout, n, sold)",
    )
    return states.groupBy("category", "week", "is_stockout", "value").agg(F.sum("n").alias("n"), F.sum("sold").alias("sold"))


def stock_value_counts(lines: DataFrame, *by: str) -> DataFrame:
    """The weighted line units as value counts per stock state and further keys."""
    return lines.where("n > 0").groupBy(*by, "is_stockout", "value").agg(F.sum("n").alias("n"))


def stock_line_rate(lines: DataFrame, *by: str) -> DataFrame:
    """Percent of (weighted) lines sold out of stock, overall or by category, with the rows behind it."""
    out = F.sum(F.when(F.col("is_stockout"), F.col("n")).otherwise(0))
    return lines.groupBy(*by).agg(percent(out, F.sum("n")).alias("stockout_pct"), F.sum("n").alias("rows"))


def stock_line_impact(lines: DataFrame) -> DataFrame:
    """Mean and median line units and rows, in and out of stock."""
    stats = summary(stock_value_counts(lines), ["is_stockout"])
    return stats.select("is_stockout", "mean", "median", F.col("count").alias("rows"))


def top_stock_lines(lines: DataFrame, k: int = 4) -> DataFrame:
    """The weighted lines of the k categories that sold the most units."""
    return keep_top_groups(lines, "category", F.col("sold") * F.col("value"), k)


def stockout_daily_rate(inventory: DataFrame) -> DataFrame:
    return known(inventory, "date").groupBy("date").agg(
        F.avg(F.col("is_stockout").cast("double")).alias("rate"),
        F.count_if(F.col("is_stockout")).alias("stockouts"),
        F.count("is_stockout").alias("rows"),
    )


def stockout_by_category(inventory: DataFrame, product: DataFrame) -> DataFrame:
    stocked = inventory.join(product.select("product_id", "category"), "product_id")
    return known(stocked, "category").groupBy("category").agg(
        F.avg(F.col("is_stockout").cast("double")).alias("rate"), F.count_if(F.col("is_stockout")).alias("stockouts")
    )


def stockout_week_rate(inventory: DataFrame, with_year: bool = False) -> DataFrame:
    """Mean of the daily rates per ISO week; weeks of different years fall together unless ``with_year``."""
    keys = [F.weekofyear("date").alias("week")]
    if with_year:
        keys.insert(0, iso_year(F.col("date")).alias("iso_year"))
    return stockout_daily_rate(inventory).groupBy(*keys).agg(F.avg("rate").alias("rate"))


def flag_rate(flags: DataFrame, flag: str, *by: str) -> DataFrame:
    return flags.groupBy(*by).agg(F.avg(F.col(flag).cast("double")).alias("rate"), F.count(flag).alias("rows"))


def stockout_cells(grid: DataFrame, cell_stockouts: DataFrame) -> DataFrame:
    return left_join_flag(grid, cell_stockouts, CELL, "has_stockout")


def cell_effect(cells: DataFrame, flag: str) -> DataFrame:
    return cells.groupBy(flag).agg(F.avg("units_sold").alias("mean_units"), F.count("units_sold").alias("rows"))
