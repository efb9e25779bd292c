"""Correlations, pivots, rolling statistics and autocorrelation of the daily series.

Every window is bounded by the calendar: a series holds one row per day.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.calendar import in_window
from demandgrid.functions.columns import flag_as_double
from demandgrid.operators.facts import known
from demandgrid.operators.quantiles import attach

SERIES = ["store_id", "category"]


def _by_date():
    return Window.orderBy("date")


def corr_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns as (a, b, r), computed in one aggregation."""
    types = dict(df.dtypes)
    numeric = df.select(
        *[(flag_as_double(F.col(c)) if types[c] == "boolean" else F.col(c).cast("double")).alias(c) for c in columns]
    )
    pairs = list(combinations(columns, 2))
    row = numeric.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    r = {(a, b): F.col(f"`{a}|{b}`") for a, b in pairs}
    r.update({(b, a): value for (a, b), value in list(r.items())})
    r.update({(a, a): F.lit(1.0) for a in columns})
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r[a, b].alias("r")) for a in columns for b in columns
    ]
    return row.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")


def corr_pair(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation; NULL below two complete rows."""
    complete = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.agg(F.when(F.count_if(complete) >= 2, F.corr(x, y)).alias("r"), F.count_if(complete).alias("rows"))


def mean_pivot(df: DataFrame, row: str, column: str, value: str = "units_sold") -> DataFrame:
    """The pivot in long form: one row per occupied (row, column) with the mean."""
    return known(df, row, column).groupBy(row, column).agg(F.avg(value).alias("mean_units"))


def mean_pivot_map(df: DataFrame, row: str, column: str, value: str = "units_sold") -> DataFrame:
    """The pivot with one row per ``row``: ``means`` maps every value of ``column`` found there to the mean.

    The columns are data, so no value has to be known beforehand and none is left out.
    """
    cells = mean_pivot(df, row, column, value)
    return cells.groupBy(row).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "mean_units")))).alias("means"))


def mean_pivot_wide(df: DataFrame, row: str, column: str, values: Sequence, value: str = "units_sold", other: str | None = "other") -> DataFrame:
    """The same pivot with one column per listed value, and one (``other``) for all values outside the list."""
    groups = known(df, row, column).groupBy(row)
    columns = [F.avg(F.when(F.col(column) == v, F.col(value))).alias(str(v)) for v in values]
    rest = [F.avg(F.when(~F.col(column).isin(list(values)), F.col(value))).alias(other)] if other else []
    return groups.agg(*columns, *rest)


def _full_frame(value: Column, frame, rows: int) -> Column:
    return F.when(F.count("units_sold").over(frame) == rows, value)


def rolling_trailing(daily: DataFrame, days: int = 7) -> DataFrame:
    """Trailing mean, deviation and band of daily units; NULL until ``days`` rows are seen."""
    frame = _by_date().rowsBetween(-(days - 1), 0)
    mean = _full_frame(F.avg("units_sold").over(frame), frame, days)
    std = _full_frame(F.stddev_samp("units_sold").over(frame), frame, days)
    return daily.select("date", "units_sold", mean.alias("mean"), std.alias("std")).withColumns(
        {"lo": F.col("mean") - F.col("std"), "hi": F.col("mean") + F.col("std")}
    )


def rolling_centered(daily: DataFrame, days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """Centred rolling mean, per series when ``by`` is given; NULL near the ends."""
    half = days // 2
    frame = Window.partitionBy(*by).orderBy("date").rowsBetween(-half, half)
    return daily.withColumn("mean", _full_frame(F.avg("units_sold").over(frame), frame, days))


def trend_residual(daily: DataFrame, days: int = 7) -> DataFrame:
    trend = rolling_trailing(daily, days).where(F.col("mean").isNotNull())
    return trend.select("date", F.col("mean").alias("trend"), (F.col("units_sold") - F.col("mean")).alias("residual"))


def acf_global_mean(daily: DataFrame, max_lag: int = 30) -> DataFrame:
    """Autocorrelation around the series mean, over its whole length, with 95 % and 99 % bands."""
    level = daily.agg(F.avg("units_sold").alias("level"), F.count("units_sold").alias("n"))
    shifted = attach(daily, level)
    centred = shifted.withColumn("x", F.col("units_sold") - F.col("level"))
    lags, by_date = range(1, max_lag + 1), _by_date()
    with_lags = centred.select("x", "n", *[F.lag("x", h).over(by_date).alias(f"lag{h}") for h in lags])
    row = with_lags.groupBy("n").agg(
        F.sum(F.col("x") * F.col("x")).alias("scale"), *[F.sum(F.col("x") * F.col(f"lag{h}")).alias(f"c{h}") for h in lags]
    )
    pairs = ", ".join(f"{h}, c{h}" for h in lags)
    return row.selectExpr("n", "scale", f"stack({max_lag}, {pairs}) AS (lag, c)").select(
        "lag",
        F.try_divide("c", "scale").alias("r"),
        (1.96 / F.sqrt("n")).alias("band95"),
        (2.58 / F.sqrt("n")).alias("band99"),
    )


def acf_pearson(series: DataFrame, by: Sequence[str] = SERIES, max_lag: int = 30) -> DataFrame:
    """Pearson correlation of each series with itself ``lag`` rows earlier, for all series at once.

    A window hands each row its ``max_lag`` predecessors; the pairs of a lag are combined on
    the map side as they are unfolded, so only one row per series and lag is shuffled.
    """
    ordered = Window.partitionBy(*by).orderBy("date")
    with_past = series.select(
        *by,
        F.col("units_sold").alias("x"),
        F.count("units_sold").over(Window.partitionBy(*by)).alias("n"),
        F.collect_list(F.struct(F.col("units_sold").alias("y"))).over(ordered.rowsBetween(-max_lag, -1)).alias("past"),
    )
    pairs = with_past.select(*by, "x", "n", F.posexplode(F.reverse("past")).alias("back", "before"))
    enough = F.count_if(F.col("x").isNotNull() & F.col("before.y").isNotNull()) >= 2
    return pairs.groupBy(*by, "n", (F.col("back") + 1).alias("lag")).agg(
        F.when(enough, F.corr("x", "before.y")).alias("r")
    ).select(*by, "lag", "r", (1.96 / F.sqrt("n")).alias("band"))


def dense_series(grid: DataFrame, more_than: int = 300) -> DataFrame:
    """Series with more than the given number of rows."""
    return grid.groupBy(SERIES).agg(F.count("units_sold").alias("rows")).where(F.col("rows") > more_than)


def densest_series(grid: DataFrame, more_than: int = 300) -> DataFrame:
    """The series with the most rows; the first by key on ties."""
    return dense_series(grid, more_than).orderBy(F.desc("rows"), *SERIES).limit(1)


def rows_of_series(grid: DataFrame, series: DataFrame) -> DataFrame:
    return grid.join(series.select(SERIES), SERIES, "left_semi")


def forecast_window_flag(daily: DataFrame, first: str, last: str) -> DataFrame:
    return daily.withColumn("in_window", in_window(F.col("date"), first, last))
