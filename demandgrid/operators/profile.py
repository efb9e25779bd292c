"""Table profiles: row counts, null shares, date ranges, cardinalities and previews."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.columns import submission_part


def _stacked(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return _stacked(
        [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows") for name, df in tables.items()]
    )


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Per table: rows, columns, and the percentage of nulls of each column that has any.

    A table without nulls yields one row with NULL column and percentage. Each table is
    aggregated once; its columns are unfolded afterwards.
    """
    return _stacked([_profile(name, df) for name, df in tables.items()])


def _profile(name: str, df: DataFrame) -> DataFrame:
    nulls = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]
    once = df.agg(F.count("*").alias("_rows"), *nulls)
    entries = [
        F.struct(F.lit(c).alias("column"), F.round(F.col(c) * 100, 1).alias("null_pct")) for c in df.columns
    ]
    with_nulls = F.filter(F.array(*entries), lambda e: e["null_pct"] > 0)
    return once.select("_rows", F.explode_outer(with_nulls).alias("entry")).select(
        F.lit(name).alias("table"),
        F.col("_rows").alias("rows"),
        F.lit(len(df.columns)).alias("cols"),
        F.col("entry.column").alias("column"),
        F.col("entry.null_pct").alias("null_pct"),
    )


def date_range_and_cardinality(order: DataFrame, inventory: DataFrame, transaction: DataFrame) -> DataFrame:
    """First and last day of orders and inventory, distinct stores and products, as (measure, value) text rows."""

    def facts_of(df: DataFrame, **measures) -> DataFrame:
        row = df.agg(*[m.cast("string").alias(name) for name, m in measures.items()])
        pairs = ", ".join(f"'{name}', {name}" for name in measures)
        return row.selectExpr(f"stack({len(measures)}, {pairs}) AS (measure, value)")

    return _stacked(
        [
            facts_of(order, order_first=F.min("date"), order_last=F.max("date"), stores=F.count_distinct("store_id")),
            facts_of(inventory, inventory_first=F.min("date"), inventory_last=F.max("date")),
            facts_of(transaction, products=F.count_distinct("product_id")),
        ]
    )


def head(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The first rows by key: a preview that is the same on every run."""
    return df.orderBy(key).limit(rows)


def date_columns(tables: Mapping[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """First day, last day and number of days of each parsed date column."""
    frames = [
        df.groupBy(F.col(c).alias("day")).count().agg(
            F.min("day").alias("first"), F.max("day").alias("last"), F.count("day").alias("days")
        ).select(F.lit(name).alias("table"), F.lit(c).alias("column"), "first", "last", "days")
        for name, (df, columns) in tables.items()
        for c in columns
    ]
    return _stacked(frames)


def submission_parts(submission: DataFrame) -> DataFrame:
    """Forecast row identifiers split from the right into cell, date and horizon."""
    return submission.select(
        "id",
        submission_part(F.col("id"), 1).alias("store_cat"),
        submission_part(F.col("id"), 2).alias("forecast_date"),
        submission_part(F.col("id"), 3).alias("horizon"),
    )


def submission_summary(parts: DataFrame) -> DataFrame:
    return parts.agg(
        F.count("*").alias("rows"),
        F.count_distinct("forecast_date").alias("dates"),
        F.min("forecast_date").alias("first"),
        F.max("forecast_date").alias("last"),
    )
