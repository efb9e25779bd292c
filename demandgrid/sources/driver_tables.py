"""Canonical retail tables derived from TPC-H-like parquet files, as column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.functions.calendar import day_name, weekday
from demandgrid.sources.star import Star

# The stand-in public holidays of the derived calendar, as month-day.
HOLIDAYS = ["01-01", "04-13", "04-14", "04-15", "05-01", "12-05", "12-31"]
# The product categories of the test tables, the columns of the wide pivot.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
RAW_SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "part": "p_partkey BIGINT, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "customer": "c_custkey BIGINT, c_mktsegment STRING, c_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_regionkey INT",
    "region": "r_regionkey INT, r_name STRING",
    "events": "user_id BIGINT, ts TIMESTAMP_NTZ, event_type STRING, value DOUBLE",
}
FORECAST_DAYS = 61
HORIZONS = [1, 3, 7]


def _transaction(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").alias("units_sold"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.round(F.col("l_discount") * 500).alias("discount_applied"),
    )


def _order(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("order_id"),
        (F.col("o_orderkey") % 25).cast("int").alias("store_id"),
        F.to_date("o_orderdate").alias("date"),
        (6 + (F.col("o_orderkey") * 31 + F.col("o_custkey")) % 16).cast("int").alias("hour"),
        F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderpriority").alias("payment_method"),
    )


def _product(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").alias("base_price"),
    )


def _store(nation: DataFrame, region: DataFrame) -> DataFrame:
    key = F.col("n_nationkey")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        key.cast("int").alias("store_id"),
        F.col("r_name").alias("neighborhood_type"),
        (20 + (key * 37) % 60).cast("int").alias("seating_capacity"),
        (3 + (key * 11) % 13).cast("int").alias("staff_count"),
        (key % 3 == 0).alias("has_drive_through"),
    )


def _date_dim(order: DataFrame) -> DataFrame:
    day = F.col("date")
    span = order.agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = span.select(F.explode(F.sequence("first", "last")).alias("date"))
    return days.select(
        "date",
        (weekday(day) >= 5).alias("is_weekend"),
        F.date_format(day, "MM-dd").isin(HOLIDAYS).alias("is_holiday"),
        (F.dayofmonth(day).isin(15, 25) | (day == F.last_day(day))).alias("is_payday"),
        F.month(day).isin(3, 4, 10).alias("is_school_break"),
        F.month(day).between(5, 10).alias("is_rainy_season"),
        day_name(day).alias("day_of_week"),
        F.month(day).alias("month"),
    )


def _promotion(part: DataFrame) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    start = F.date_add(F.lit("1995-01-01").cast("date"), ((key * 13) % 2300).cast("int"))
    kind = F.when(size % 4 == 0, "bundle").when(size % 4 == 1, "discount").when(size % 4 == 2, "bogo")
    return part.where(key % 10 == 0).select(
        (F.floor(key / 10.0) % 25).cast("int").alias("store_id"),
        key.alias("product_id"),
        kind.otherwise("happy_hour").alias("promo_type"),
        (5 + 5 * (F.floor(key / 10.0) % 9)).cast("double").alias("discount_pct"),
        start.alias("start_date"),
        F.date_add(start, (size % 14).cast("int")).alias("end_date"),
    )


def _local_event(orders: DataFrame) -> DataFrame:
    """Every 970th order stands for two events on its store-day, hence the exploded pair of types."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    kinds = F.when(key % 970 == 0, F.array(status, F.lit("REPEAT"))).otherwise(F.array(status))
    return orders.where(key % 97 == 0).select(
        (key % 25).cast("int").alias("store_id"),
        F.to_date("o_orderdate").alias("date"),
        F.explode(kinds).alias("event_type"),
    )


def _inventory(transaction: DataFrame, order: DataFrame) -> DataFrame:
    lines = transaction.join(order, "order_id")
    return lines.groupBy("store_id", "product_id", "date").agg(
        F.bool_or(F.col("units_sold") >= 46).alias("is_stockout")
    )


def _customer(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"),
    )


def _submission(store: DataFrame, product: DataFrame, order: DataFrame) -> DataFrame:
    categories = product.agg(F.collect_set("category")).scalar()
    last_day = order.agg(F.max("date")).scalar()
    offsets = F.sequence(F.lit(0), F.lit(FORECAST_DAYS - 1))
    cells = (
        store.select("store_id", categories.alias("categories"), last_day.alias("last_day"))
        .select("store_id", F.explode("categories").alias("category"), "last_day")
        .select("store_id", "category", "last_day", F.explode(offsets).alias("back"))
        .select("store_id", "category", F.expr("date_sub(last_day, back)").alias("date"))
        .select("*", F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("h"))
    )
    named = F.concat_ws("_", F.col("store_id").cast("string"), "category", F.col("date").cast("string"), F.concat("h", F.lit("d")))
    return cells.select(named.alias("id"))


class _DriverTables:
    """Sets up one canonical table at a time, so a job opens only the files it needs."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def _raw(self, name: str) -> DataFrame:
        return self._spark.read.schema(RAW_SCHEMAS[name]).parquet(f"{self._folder}/{name}.parquet")

    def __call__(self, name: str) -> DataFrame:
        raw = self._raw
        match name:
            case "transaction":
                return _transaction(raw("lineitem"))
            case "order":
                return _order(raw("orders"))
            case "product":
                return _product(raw("part"))
            case "store":
                return _store(raw("nation"), raw("region"))
            case "date_dim":
                return _date_dim(_order(raw("orders")))
            case "promotion":
                return _promotion(raw("part"))
            case "local_event":
                return _local_event(raw("orders"))
            case "inventory":
                return _inventory(_transaction(raw("lineitem")), _order(raw("orders")))
            case "customer":
                return _customer(raw("customer"))
            case "submission":
                return _submission(_store(raw("nation"), raw("region")), _product(raw("part")), _order(raw("orders")))
            case _:
                raise KeyError(name)


def driver_star(spark: SparkSession, folder: str) -> Star:
    """The canonical star over ``folder``'s parquet files; nothing is read until an action."""
    return Star(_DriverTables(spark, folder), folder)


def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    """The ``events`` table as hour-of-day demand: units by store, category and hour."""
    return spark.read.schema(RAW_SCHEMAS["events"]).parquet(f"{folder}/events.parquet").select(
        (F.col("user_id") % 25).cast("int").alias("store_id"),
        F.col("event_type").alias("category"),
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hour"),
        F.col("value").alias("units_sold"),
    )
