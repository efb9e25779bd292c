"""Calendar columns. Weekdays count Monday as 0; weeks are ISO weeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def day_name(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def weekday(day: Column) -> Column:
    return F.weekday(day)


def iso_year(day: Column) -> Column:
    """The year an ISO week belongs to: that of the week's Thursday."""
    return F.year(F.date_add(day, 3 - F.weekday(day)))


def calendar_features(df: DataFrame, column: str = "date") -> DataFrame:
    """Adds day_name, month, week, iso_year and weekday of ``column``."""
    day = F.col(column)
    return df.withColumns(
        {
            "day_name": day_name(day),
            "month": F.month(day),
            "week": F.weekofyear(day),
            "iso_year": iso_year(day),
            "weekday": weekday(day),
        }
    )


def ordered_weekday(by_weekday: DataFrame) -> DataFrame:
    """One row per weekday Monday..Sunday; a weekday missing from the input keeps NULL measures."""
    spark = by_weekday.sparkSession
    names = F.array(*[F.lit(name) for name in WEEKDAYS])
    week = spark.range(len(WEEKDAYS)).select(
        F.col("id").cast("int").alias("weekday"), F.get(names, F.col("id").cast("int")).alias("day_name")
    )
    return week.join(by_weekday, "weekday", "left").orderBy("weekday")


def in_window(day: Column, first: str, last: str) -> Column:
    """True on the days of the closed window, e.g. the forecast period."""
    return day.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
