"""Declared schemas of the canonical retail tables (no inference at load time)."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in columns])


_LONG, _INT, _DOUBLE, _TEXT, _DATE, _FLAG = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.DateType(), T.BooleanType(),
)

CALENDAR_FLAGS = ("is_weekend", "is_holiday", "is_payday", "is_school_break", "is_rainy_season")

SCHEMAS: dict[str, T.StructType] = {
    "transaction": _table(
        ("order_id", _LONG, False), ("product_id", _LONG, False), ("units_sold", _DOUBLE, False),
        ("revenue", _DOUBLE, False), ("discount_applied", _DOUBLE, False),
    ),
    "order": _table(
        ("order_id", _LONG, False), ("store_id", _INT, False), ("date", _DATE, False),
        ("hour", _INT, False), ("customer_id", _LONG, True), ("payment_method", _TEXT, False),
    ),
    "product": _table(("product_id", _LONG, False), ("category", _TEXT, False), ("base_price", _DOUBLE, False)),
    "store": _table(
        ("store_id", _INT, False), ("neighborhood_type", _TEXT, False), ("seating_capacity", _INT, False),
        ("staff_count", _INT, False), ("has_drive_through", _FLAG, False),
    ),
    "date_dim": _table(
        ("date", _DATE, False), *[(flag, _FLAG, False) for flag in CALENDAR_FLAGS],
        ("day_of_week", _TEXT, False), ("month", _INT, False),
    ),
    "promotion": _table(
        ("store_id", _INT, False), ("product_id", _LONG, False), ("promo_type", _TEXT, False),
        ("discount_pct", _DOUBLE, False), ("start_date", _DATE, False), ("end_date", _DATE, False),
    ),
    "local_event": _table(("store_id", _INT, False), ("date", _DATE, False), ("event_type", _TEXT, False)),
    "inventory": _table(
        ("store_id", _INT, False), ("product_id", _LONG, False), ("date", _DATE, False), ("is_stockout", _FLAG, False),
    ),
    "customer": _table(("customer_id", _LONG, False), ("segment", _TEXT, True), ("balance", _DOUBLE, True)),
    "submission": _table(("id", _TEXT, False)),
}
