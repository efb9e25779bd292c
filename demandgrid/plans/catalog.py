"""Registry of reports: a name, a Spark builder and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.plans.oracle import sql
from demandgrid.sources.star import Star

Builder = Callable[[Star], DataFrame]


@dataclass(frozen=True)
class Report:
    name: str
    build: Builder
    sql: str | None


REPORTS: dict[str, Report] = {}


def add(name: str, build: Builder, oracle: str | None) -> None:
    if name in REPORTS:
        raise ValueError(f"report {name} is registered twice")
    REPORTS[name] = Report(name, build, sql(oracle) if oracle else None)


def report(name: str, oracle: str | None = None) -> Callable[[Builder], Builder]:
    """Registers the decorated builder under ``name``."""

    def register(build: Builder) -> Builder:
        add(name, build, oracle)
        return build

    return register


def shown(df: DataFrame, digits: int = 4, **digits_of: int) -> DataFrame:
    """Rounds floating columns for display and comparison; a negative zero becomes zero."""
    return df.select(
        *[
            F.round(F.col(f"`{name}`"), digits_of.get(name, digits)).alias(name) if kind == "double" else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )
