"""Loading by name, unknown numbers, safe writes, and columns that follow the data."""

from types import SimpleNamespace

import pytest
from demandgrid.operators import distribution, facts, features, groups, quantiles, series
from demandgrid.session import shared_folder
from demandgrid.sources.schemas import SCHEMAS
from demandgrid.sources.sink import in_order, with_bucketed_lines, with_written_target, write_result, write_text
from demandgrid.sources.star import Star, load_tables, parse_failures
from pyspark.sql import functions as F

FILES = {
    "transaction": ("line,units_sold,product_id,order_id,revenue,discount_applied", ["9,2,7,1,20.5,5", "8,x,7,1,NaN,", "7,1.5,7,1,3,0"]),
    "order": ("date,order_id,store_id,hour,customer_id,payment_method", ["2024-11-01 08:00:00,1,3,8,,cash", "no day,2,3,9.0,4,card"]),
    "product": ("category,base_price,product_id", ["Tea,2.5,7"]),
    "store": ("store_id,neighborhood_type,seating_capacity,staff_count,has_drive_through", ["3,Mall,10,2,TRUE", "4,Mall,10,2.5,0"]),
    "date_dim": ("date,is_weekend,is_holiday,is_payday,is_school_break,is_rainy_season,day_of_week,month", ["2024-11-01,0,1,false,True,1,Friday,11"]),
    "promotion": ("store_id,product_id,promo_type,discount_pct,start_date,end_date", ["3,7,bogo,5,2024-11-01,2024-11-02"]),
    "local_event": ("store_id,date,event_type", ["3,2024-11-01,fair"]),
    "inventory": ("is_stockout,store_id,product_id,date", ["1,3,7,2024-11-01", "maybe,3,7,2024-11-01", "0,3,7,2024-11-02"]),
    "customer": ("customer_id,segment,balance", ["4,gold,1"]),
    "submission": ("id", ["3_Tea_2024-11-01_1d"]),
}


@pytest.fixture()
def csv_folder(tmp_path):
    for name, (header, rows) in FILES.items():
        (tmp_path / f"{name}.csv").write_text("\n".join([header, *rows]) + "\n")
    return tmp_path


def test_csv_is_read_by_name(spark, csv_folder):
    tables = load_tables(spark, str(csv_folder))
    assert {n: t.columns for n, t in tables.items()} == {n: s.names for n, s in SCHEMAS.items()}
    assert [tuple(r) for r in tables["transaction"].collect()] == [(1, 7, 2.0, 20.5, 5.0), (1, 7, None, None, None), (1, 7, 1.5, 3.0, 0.0)]
    assert [tuple(r) for r in tables["product"].collect()] == [(7, "Tea", 2.5)]
    assert [r.is_stockout for r in tables["inventory"].collect()] == [True, None, False]
    assert [(r.staff_count, r.has_drive_through) for r in tables["store"].collect()] == [(2, True), (None, False)]
    assert [str(r.date) for r in tables["order"].collect()] == ["2024-11-01", "None"]
    failed = {(r.table, r.column): r.failed for r in parse_failures(spark, str(csv_folder)).collect() if r.failed}
    assert failed == {
        ("transaction", "units_sold"): 1, ("transaction", "revenue"): 1, ("order", "date"): 1, ("store", "staff_count"): 1, ("inventory", "is_stockout"): 1,
    }


def test_parse_failures_are_counted_in_the_same_pass(spark, csv_folder):
    failures = {}
    tables = load_tables(spark, str(csv_folder), failures=failures)
    assert tables["transaction"].agg(F.sum("units_sold")).first()[0] == 3.5
    assert failures["transaction"].get == {"_rows": 3, "order_id": 0, "product_id": 0, "units_sold": 1, "revenue": 1, "discount_applied": 0}
    tables["order"].count()
    assert failures["order"].get["date"] == 1


def test_a_star_survives_its_way_through_text(spark, star):
    tables = load_tables(spark, write_text(star))
    for name in ("order", "store", "date_dim", "promotion"):
        assert sorted(map(str, tables[name].collect())) == sorted(map(str, star.tables[name].select(tables[name].columns).collect())), name


def test_position_is_the_order_as_data(spark):
    table = spark.range(5000).selectExpr("id", "id * 7919 % 613 AS x").repartition(7)
    placed = in_order(table, "test", F.desc("x"), "id")
    expected = sorted(((-(k * 7919 % 613), k) for k in range(5000)))
    assert [(r.position, r.id) for r in placed.orderBy("position").collect()] == [(n, k) for n, (_, k) in enumerate(expected, 1)]
    assert in_order(table.limit(0), "test", "x").collect() == []


def test_bucketed_lines_join_without_moving(spark, star):
    from test_plans import final_plan

    bucketed = with_bucketed_lines(star, 4)
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(key, None) for key in keys]
    for key in keys:
        spark.conf.set(key, "-1")
    try:
        lines = bucketed.transaction.join(bucketed.order.select("order_id", "store_id"), "order_id")
        plan = final_plan(lines.agg(F.sum("units_sold"), F.count("*")))
        plain = final_plan(star.transaction.join(star.order.select("order_id", "store_id"), "order_id").agg(F.sum("units_sold")))
    finally:
        for key, value in zip(keys, before):
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    below = plan[plan.index("SortMergeJoin"):]
    assert "Exchange" not in below and "Exchange" in plain[plain.index("SortMergeJoin"):]
    assert sorted(bucketed.target.collect()) == sorted(star.target.collect())


def test_a_missing_column_is_an_error(spark, csv_folder):
    (csv_folder / "product.csv").write_text("product_id,base_price\n7,2.5\n")
    with pytest.raises(ValueError, match="no column category"):
        load_tables(spark, str(csv_folder))


def test_nan_is_unknown(spark):
    nan = float("nan")
    table = spark.createDataFrame([(1, 10 * k, v, v, 0.0) for k, v in enumerate([1.0, 2.0, 3.0, nan])], SCHEMAS["transaction"])
    lines = Star({"transaction": table}.__getitem__).transaction
    assert quantiles.summary(quantiles.value_counts(table, "units_sold")).first().median == 2.0
    assert lines.agg(F.avg("units_sold")).first()[0] == 2.0 and series.corr_pair(lines, "units_sold", "revenue").first().rows == 3
    assert sum(r["count"] for r in distribution.histogram(lines, "units_sold", 2).collect()) == 3


def test_writes_never_replace_what_is_read(spark, star):
    once = with_written_target(star)
    twice = with_written_target(once)
    assert once.target.count() == twice.target.count() == star.target.count()
    assert write_result(star.store, "same") != write_result(star.store, "same")


def test_a_missing_folder_is_one_clear_error():
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(spark)


def test_a_seventh_category_and_a_fifth_promotion_type_appear(spark):
    target = spark.createDataFrame([(1, c, k + 1.0) for k, c in enumerate("ABCDEFG")], "store_id int, category string, units_sold double")
    assert series.mean_pivot_map(target, "store_id", "category").first().means == {c: k + 1.0 for k, c in enumerate("ABCDEFG")}
    assert series.mean_pivot_wide(target, "store_id", "category", list("ABCDEF")).first().other == 7.0
    days = spark.createDataFrame(
        [(1, "A", "2024-01-01", 5.0, t) for t in ("bogo", "new", "bogo")], "store_id int, category string, date string, discount_pct double, promo_type string"
    )
    assert features.promo_type_days(days).first().promo_types == "bogo,new"
    listed = features.promo_type_days(days, ["bogo", "bundle"]).first()
    assert (listed.promo_bogo, listed.promo_bundle, listed.promo_other) == (1, 0, 1)


def test_readiness_is_measured_against_the_tables(spark):
    target = spark.createDataFrame([(1, "A", "2024-01-01"), (1, "B", "2024-01-04")], "store_id int, category string, date string").withColumn("date", F.to_date("date"))
    store, product = spark.range(1, 3).toDF("store_id"), spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "category string")
    assert tuple(groups.data_readiness(target, store, product).first()) == (6.25, 50.0, 50.0, 50.0)


def test_quantile_reports_read_the_lines_once(star):
    from demandgrid.plans import REPORTS
    from test_plans import scans_run

    for name in ("w5_hour_neighborhood_weekday", "d13_describe_of_describe"):
        found = [n for n in REPORTS if n.startswith(name)]
        for n in found[:1]:
            assert scans_run(REPORTS[n].build(star), "lineitem.parquet") == 1, n
    assert facts.grid_zero_rate(star.grid).count() == 1
