"""Forecasting features per store, category and day, using the past only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.calendar import weekday
from demandgrid.operators.effects import event_store_days, flag_rows
from demandgrid.operators.facts import CELL, known, left_join_flag

SERIES = ["store_id", "category"]
LAGS = [1, 7, 14, 28]
WINDOWS = [7, 14, 28]
HORIZONS = [1, 3, 7]


def _series_by_day():
    return Window.partitionBy(*SERIES).orderBy("date")


def _past(days: int, gap: int = 1):
    """The ``days`` rows that end ``gap`` days before the current one."""
    return _series_by_day().rowsBetween(-(days + gap - 1), -gap)


def lag_features(grid: DataFrame, lags: Sequence[int] = LAGS) -> DataFrame:
    return grid.select(*CELL, "units_sold", *[F.lag("units_sold", h).over(_series_by_day()).alias(f"lag_{h}") for h in lags])


def rolling_features(grid: DataFrame, windows: Sequence[int] = WINDOWS, std_window: int = 7) -> DataFrame:
    """Rolling means and one deviation over past days; NULL until the window is full."""

    def full(value, days):
        return F.when(F.count("units_sold").over(_past(days)) == days, value)

    means = [full(F.avg("units_sold").over(_past(w)), w).alias(f"rolling_{w}_mean") for w in windows]
    std = full(F.stddev_samp("units_sold").over(_past(std_window)), std_window).alias(f"rolling_{std_window}_std")
    return grid.select(*CELL, "units_sold", *means, std)


def horizon_safe_features(grid: DataFrame, horizons: Sequence[int] = HORIZONS, window: int = 7) -> DataFrame:
    """One row per cell and horizon h, with only what is known h days earlier.

    Lags shorter than h are NULL; the rolling mean ends h days back.
    """
    def rolling(h):
        frame = _past(window, h)
        return F.when(F.count("units_sold").over(frame) == window, F.avg("units_sold").over(frame))

    based = grid.select(
        *CELL,
        "units_sold",
        *[F.lag("units_sold", lag).over(_series_by_day()).alias(f"lag_{lag}") for lag in LAGS],
        F.array(*[F.struct(F.lit(h).alias("horizon"), rolling(h).alias("rolling_mean")) for h in horizons]).alias("known"),
    )
    rows = based.select(*CELL, "units_sold", *[f"lag_{lag}" for lag in LAGS], F.explode("known").alias("k"))
    return rows.select(
        *CELL,
        F.col("k.horizon").alias("horizon"),
        "units_sold",
        *[F.when(F.col("k.horizon") <= lag, F.col(f"lag_{lag}")).alias(f"lag_{lag}") for lag in LAGS],
        F.col("k.rolling_mean").alias("rolling_mean"),
    )


def promo_type_days(promo_days: DataFrame, promo_types: Sequence[str] = ()) -> DataFrame:
    """Per cell: mean discount, all promotion types present (sorted, joined by commas), and for each listed type a 0/1 column.

    With a list there is one more column, ``promo_other``, for types outside it.
    """
    def dummy(condition, name):
        return F.max(F.when(condition, 1).otherwise(0)).alias(f"promo_{name}")

    dummies = [dummy(F.col("promo_type") == kind, kind) for kind in promo_types]
    dummies += [dummy(~F.col("promo_type").isin(list(promo_types)), "other")] if promo_types else []
    types = F.array_join(F.sort_array(F.collect_set("promo_type")), ",").alias("promo_types")
    return known(promo_days, *CELL).groupBy(CELL).agg(F.avg("discount_pct").alias("avg_discount"), types, *dummies)


def calendar_store_features(
    grid: DataFrame, date_dim: DataFrame, store: DataFrame, promo_days: DataFrame, local_event: DataFrame,
    cell_stockouts: DataFrame, promo_types: Sequence[str] = (),
) -> DataFrame:
    """Calendar flags, store attributes, promotion, event and yesterday's stockout for each cell."""
    dummies = [f"promo_{kind}" for kind in [*promo_types, "other"] if promo_types]
    promos = promo_type_days(promo_days, promo_types).withColumn("has_promo", F.lit(True))
    flagged = (
        grid.join(promos, CELL, "left")
        .withColumns({"has_promo": F.coalesce("has_promo", F.lit(False)), "promo_types": F.coalesce("promo_types", F.lit("")), **{d: F.coalesce(d, F.lit(0)) for d in dummies}})
    )
    flagged = left_join_flag(flagged, cell_stockouts, CELL, "has_stockout")
    flagged = flag_rows(flagged, event_store_days(local_event), ["store_id", "date"], "has_local_event")
    yesterday = F.lag("has_stockout", 1).over(_series_by_day())
    return (
        flagged.withColumn("yesterday_stockout", yesterday)
        .drop("has_stockout")
        .join(date_dim.drop("day_of_week"), "date", "left")
        .join(store, "store_id", "left")
        .withColumn("weekday", weekday(F.col("date")))
    )


def weekday_encoding(df: DataFrame) -> DataFrame:
    """Weekday as seven 0/1 columns and as a point on the weekly cycle."""
    day = weekday(F.col("date"))
    angle = day * (2 * F.pi() / 7)
    return df.withColumns(
        {
            **{f"weekday_{i}": (day == i).cast("int") for i in range(7)},
            "weekday_sin": F.sin(angle),
            "weekday_cos": F.cos(angle),
        }
    )


def target_encode(grid: DataFrame) -> DataFrame:
    """Mean units of the series' earlier days: the store-category identity without leakage."""
    before = _series_by_day().rowsBetween(Window.unboundedPreceding, -1)
    return grid.select(*CELL, "units_sold", F.avg("units_sold").over(before).alias("past_mean"))


def seasonal_prediction(grid: DataFrame, horizons: Sequence[int] = HORIZONS, season: int = 7) -> DataFrame:
    """A check prediction: the value a whole number of weeks back, at least ``h`` days ago."""
    steps = {h: season * -(-h // season) for h in horizons}
    known = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.lag("units_sold", step).over(_series_by_day()).alias("predicted"))
        for h, step in steps.items()
    ])
    rows = grid.select(*CELL, "units_sold", known.alias("known")).withColumn("p", F.explode("known"))
    return rows.select(*CELL, "units_sold", "p.*")


def mae_eval(predictions: DataFrame) -> DataFrame:
    """Mean absolute error per horizon over the rows that have a prediction."""
    error = F.abs(F.col("units_sold") - F.col("predicted"))
    return predictions.groupBy("horizon").agg(F.avg(error).alias("mae"), F.count(error).alias("rows"))


def stockout_weight(cells: DataFrame, weight: float = 0.5) -> DataFrame:
    """Down-weights cells whose recorded units were limited by stock."""
    return cells.withColumn("weight", F.when(F.col("has_stockout"), weight).otherwise(1.0))
