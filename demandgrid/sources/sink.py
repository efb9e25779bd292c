"""Written tables in the shared folder: results, text exports, tables in order, bucketed facts; a fresh directory for every write."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.session import shared_folder
from demandgrid.sources.schemas import SCHEMAS
from demandgrid.sources.star import Star

ROWS_OF_PARTITION = 33  # bits that monotonically_increasing_id leaves for the rows of a partition


def _fresh(df: DataFrame, name: str, folder: str | None) -> str:
    return f"{folder or shared_folder(df.sparkSession)}/results/{name}-{uuid.uuid4().hex}"


def write_result(df: DataFrame, name: str, folder: str | None = None, partition_by: list[str] | None = None) -> str:
    """Write ``df`` as parquet under ``folder`` (default: the cluster's shared folder); returns the path.

    Every write gets a directory of its own, so nothing that a running query or another session reads is replaced.
    """
    path = _fresh(df, name, folder)
    writer = df.write
    if partition_by:
        writer = df.repartition(*partition_by).write.partitionBy(*partition_by)
    writer.parquet(path)
    return path


def write_text(star: Star, folder: str | None = None) -> str:
    """Every canonical table as CSV with a header, dates as text and flags as 1 and 0; returns the folder, for ``load_tables``."""
    path = _fresh(star.store, "text", folder)
    for name, schema in SCHEMAS.items():
        df = getattr(star, name)
        text = [(F.col(f.name).cast("int") if f.dataType.typeName() == "boolean" else F.col(f.name)).cast("string").alias(f.name) for f in schema]
        df.select(text).write.option("header", True).csv(f"{path}/{name}.csv")
    return path


def in_order(df: DataFrame, name: str, *order: str | Column, folder: str | None = None) -> DataFrame:
    """``df`` with its 1-based ``position`` in the given order, as data that a later shuffle cannot lose.

    Rows are dealt out by range and sorted inside their partitions, written with their place, and a partition's
    places are moved by the sizes of those before it (one row per partition). Ties are placed arbitrarily, but once: the written
    places are what every reader sees.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_spot", F.monotonically_increasing_id())
    rows = df.sparkSession.read.schema(placed.schema).parquet(write_result(placed, name, folder))
    part = F.shiftright("_spot", ROWS_OF_PARTITION)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_spot").bitwiseAND((1 << ROWS_OF_PARTITION) - 1) + 1
    return rows.withColumn("_part", part).join(starts, "_part").select(*df.columns, place.alias("position"))


def with_bucketed_lines(star: Star, buckets: int, folder: str | None = None) -> Star:
    """A star whose order lines and orders are read from tables bucketed and sorted by order.

    Their join, the largest of all, then moves no row: both sides are laid out alike, written once. ``buckets`` is chosen
    by size: a bucket of lines should fit a task, some hundred MB. Each write task fills one bucket, so there is one file each.
    """
    tables = {}
    for name in ("transaction", "order"):
        df = getattr(star, name)
        table = f"{name}_{uuid.uuid4().hex}"
        bucketed = df.repartition(buckets, "order_id").write.bucketBy(buckets, "order_id").sortBy("order_id")
        bucketed.option("path", _fresh(df, f"bucketed-{name}", folder)).format("parquet").saveAsTable(table)
        tables[name] = df.sparkSession.table(table)
    return Star(lambda name: tables[name] if name in tables else star.table(name), star.folder)


def with_written_target(star: Star, folder: str | None = None) -> Star:
    """A star whose daily target is read back from a written table.

    The target is the one relation most reports start from and is smaller than the order lines
    by orders of magnitude. Writing it first lets a whole set of reports read the lines once,
    and a lost executor costs a re-read instead of the joins.
    """
    path = write_result(star.target, "daily_target", folder)
    written = Star(star.table, star.folder)
    written.target = star.transaction.sparkSession.read.parquet(path)
    return written


def write_grid(star: Star, folder: str | None = None) -> str:
    """The zero-filled grid with calendar columns, one directory per year and month for date-pruned reads."""
    return write_result(star.calendar_grid.withColumn("year", F.year("date")), "calendar_grid", folder, ["year", "month"])
