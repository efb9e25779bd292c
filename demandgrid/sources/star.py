"""The star of canonical tables and the relations every analysis starts from."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.functions.columns import known_number
from demandgrid.operators import facts
from demandgrid.sources.schemas import SCHEMAS


def parse_dates(df: DataFrame, *columns: str) -> DataFrame:
    """Cast text or timestamp columns to calendar dates; what is no date becomes NULL."""
    return df.withColumns({name: F.col(name).try_cast("date") for name in columns})


def _path(folder: str, name: str, fmt: str, file_names: Mapping[str, str] | None) -> str:
    return f"{folder}/{(file_names or {}).get(name, f'{name}.{fmt}')}"


def read_named(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` by name, as the file has them (CSV: as text); a missing column is an error."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df.select([f.name for f in schema])


def typed(column: Column, kind: T.DataType) -> Column:
    """A column as ``kind``: flags from true/false, t/f, yes/no and 1/0 in any case, NaN as unknown; what does not parse becomes NULL."""
    if isinstance(kind, T.BooleanType):
        text = F.lower(F.trim(column.cast("string")))
        return F.when(text.isin("true", "t", "yes", "y", "1", "1.0"), True).when(text.isin("false", "f", "no", "n", "0", "0.0"), False)
    if isinstance(kind, T.StringType):
        return column.cast(kind)
    if isinstance(kind, T.DoubleType):
        return known_number(column.try_cast(kind))
    if isinstance(kind, (T.LongType, T.IntegerType)):  # whole numbers written as 3.0 count; 3.5 does not
        whole = F.coalesce(column.try_cast(kind), column.try_cast("double").try_cast(kind))
        return F.when(column.try_cast("double") == whole, whole)
    return column.try_cast(kind)


def _failures(schema: T.StructType) -> list[Column]:
    """Per column, how many present values do not parse as the declared type."""
    values = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in schema}
    return [F.count_if(value.isNotNull() & typed(value, kind).isNull()).alias(name) for name, (value, kind) in values.items()]


def load_tables(
    spark: SparkSession, folder: str, fmt: str = "csv", file_names: Mapping[str, str] | None = None,
    failures: dict[str, Observation] | None = None,
) -> dict[str, DataFrame]:
    """Read each canonical table of ``folder``: columns by name in any order, others ignored, cast to the declared types.

    A dictionary passed as ``failures`` gets an observation per table: after the first action on a table its ``get`` has, by
    column, how many values did not parse, counted in the same pass (which then reads every column).
    """
    tables = {}
    for name, schema in SCHEMAS.items():
        raw = read_named(spark, _path(folder, name, fmt, file_names), fmt, schema)
        if failures is not None:
            failures[name] = Observation(f"{name} {uuid.uuid4().hex}")
            raw = raw.observe(failures[name], F.count(F.lit(1)).alias("_rows"), *_failures(schema))
        tables[name] = raw.select([typed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in schema])
    return tables


def parse_failures(
    spark: SparkSession, folder: str, fmt: str = "csv", file_names: Mapping[str, str] | None = None
) -> DataFrame:
    """(table, column, failed): how many present values of each column do not parse as the declared type; one pass per table."""
    parts = []
    for name, schema in SCHEMAS.items():
        raw = read_named(spark, _path(folder, name, fmt, file_names), fmt, schema)
        failed = _failures(schema)
        names = ", ".join(f"'{f.name}', `{f.name}`" for f in schema)
        parts.append(raw.agg(*failed).selectExpr(f"'{name}' AS `table`", f"stack({len(schema)}, {names}) AS (column, failed)"))
    return reduce(DataFrame.union, parts)


class Star:
    """The canonical tables, each set up when first asked for, and the relations derived from them."""

    transaction: DataFrame
    order: DataFrame
    product: DataFrame
    store: DataFrame
    date_dim: DataFrame
    promotion: DataFrame
    local_event: DataFrame
    inventory: DataFrame
    customer: DataFrame
    submission: DataFrame

    def __init__(self, table: Callable[[str], DataFrame], folder: str | None = None):
        self.table = table
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in SCHEMAS:
            raise AttributeError(name)
        df = self.table(name)
        unknown = {f.name: known_number(F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType)}
        df = df.withColumns(unknown) if unknown else df
        setattr(self, name, df)
        return df

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}

    @cached_property
    def fact(self) -> DataFrame:
        return facts.master_fact(self.transaction, self.order, self.product, self.store, self.date_dim)

    @cached_property
    def target(self) -> DataFrame:
        return facts.daily_target(self.transaction, self.order, self.product)

    @cached_property
    def calendar_target(self) -> DataFrame:
        return facts.enrich_target(self.target, self.date_dim, self.store)

    @cached_property
    def grid(self) -> DataFrame:
        return facts.full_grid(self.target)

    @cached_property
    def calendar_grid(self) -> DataFrame:
        return facts.left_join_calendar(self.grid, self.date_dim)

    @cached_property
    def promo_days(self) -> DataFrame:
        return facts.promo_daily_long(self.promotion, self.product, self.date_dim)
