"""Small literal frames for the rules that decide answers: nulls, ties, bins, quantiles, windows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from demandgrid.functions import calendar, columns
from demandgrid.operators import distribution as dist
from demandgrid.operators import effects, facts, features, groups, profile, ranking, series
from demandgrid.operators.quantiles import SLOTS, quantiles, rank_spans, slotted, summary, value_counts
from demandgrid.plans import REPORTS
from demandgrid.sources.star import Star


def frame(spark, values, name="units_sold"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


def days(spark, values, first=dt.date(2024, 1, 1)):
    rows = [(first + dt.timedelta(i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, units_sold double")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_unknown_keys_form_no_group(spark):
    df = spark.createDataFrame([(None, 1.0), ("a", 2.0)], "category string, units_sold double")
    assert rows(groups.units_by(df, "category", "units")) == [("a", 2.0)]


def test_quantiles_interpolate(spark):
    counts = value_counts(frame(spark, [1, 2, 2, 9]), "units_sold")
    row = quantiles(counts, {"q75": 0.75, "low": 0.0, "high": 1.0}).first()
    assert (row.q75, row.low, row.high) == (3.75, 1.0, 9.0)


def test_summary_of_empty_single_and_constant(spark):
    empty = summary(value_counts(frame(spark, [None, None]), "units_sold")).first()
    assert empty["count"] == 0 and empty["mean"] is None and empty["median"] is None
    single = summary(value_counts(frame(spark, [7]), "units_sold")).first()
    assert single["count"] == 1 and single["std"] is None and single["median"] == 7.0
    constant = summary(value_counts(frame(spark, [3, 3, 3]), "units_sold")).first()
    assert (constant["std"], constant["q25"], constant["max"]) == (0.0, 3.0, 3.0)


def test_summary_against_brute_force_with_negative_and_wide_values(spark):
    import numpy as np

    generator = np.random.default_rng(5)
    values = np.concatenate([generator.normal(0, 1, 300), generator.lognormal(8, 3, 200), [-1e6, 0, 0, 0]]).round(3)
    row = summary(value_counts(frame(spark, values.tolist()), "units_sold")).first()
    for name, p in (("q25", 25), ("median", 50), ("q75", 75)):
        assert row[name] == pytest.approx(np.percentile(values, p))
    assert row["std"] == pytest.approx(values.std(ddof=1)) and row["mean"] == pytest.approx(values.mean())


def test_ranks_cover_every_position_once(spark):
    spans = rank_spans(value_counts(frame(spark, [5, 5, -3, 100, 5, 0, 0.5]), "units_sold")).orderBy("first").collect()
    assert [(s.value, s["first"], s["last"]) for s in spans] == [(-3, 0, 0), (0, 1, 1), (0.5, 2, 2), (5, 3, 5), (100, 6, 6)]


def test_quantiles_with_one_dominating_value(spark):
    df = spark.createDataFrame([("hot", 1.0)] * 500 + [("hot", 9.0)] * 2 + [("cold", 4.0)], "k string, x double")
    got = quantiles(value_counts(df, "x", ["k"]), {"m": 0.5, "top": 0.999}, ["k"]).orderBy("k").collect()
    assert [(r.k, r.m) for r in got] == [("cold", 4.0), ("hot", 1.0)] and got[1].top > 8


def test_both_skewness_definitions(spark):
    row = dist.skewness(frame(spark, [1, 2, 2, 9])).first()
    assert row.skew_biased == pytest.approx(1.0970254493638671)
    assert row.skew_corrected == pytest.approx(1.9001038154942962)
    assert dist.skewness(frame(spark, [1])).first().skew_corrected is None


def test_single_row_deviation_and_correlation_are_null(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    assert df.agg(F.stddev_samp("x")).first()[0] is None
    assert series.corr_pair(df, "x", "y").first().r is None


def test_discount_bands_are_right_closed_and_skip_zero(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 10.0, 10.5, 100.0)], "d double")
    assert [r[0] for r in df.select(columns.right_closed_bin(F.col("d"), [0, 10, 20, 30, 40, 100])).collect()] == [None, 1, 2, 5]


def test_undiscounted_lines_only_on_request(spark):
    df = spark.createDataFrame([(0.0, 1.0, 5.0, 1.0), (10.0, 2.0, 6.0, 1.0)], "discount_applied double, units_sold double, revenue double, base_price double")
    assert [r.bin for r in dist.discount_bands(df).collect()] == [1]
    assert sorted(r.bin for r in dist.discount_bands(df, with_undiscounted=True).collect()) == [0, 1]


def test_quantile_bins_merge_equal_edges(spark):
    got = dist.quantile_bins(value_counts(frame(spark, [0, 0, 0, 0, 1, 2, 3, 4, 5, 6]), "units_sold"), 5)
    assert [(round(r.lo, 6), round(r.hi, 6), r["count"]) for r in got.orderBy("bin").collect()] == [
        (0, 0.6, 4), (0.6, 2.4, 2), (2.4, 4.2, 2), (4.2, 6, 2)]


def test_quantile_bins_of_a_constant_are_empty(spark):
    assert dist.quantile_bins(value_counts(frame(spark, [2, 2]), "units_sold"), 5).count() == 0


def test_equal_width_cut_lowers_the_first_edge(spark):
    got = dist.cut_equal_width(frame(spark, [5, 45, 13, 20], "x"), "x", 5, {"n": F.lit(1)}, count=True).orderBy("bin").collect()
    assert [r["count"] for r in got] == [2, 1, 0, 0, 1] and [r.n for r in got] == [1, 1, None, None, 1]
    assert got[0].lo == pytest.approx(4.96) and got[-1].hi == 45.0


def test_equal_width_cut_of_a_constant_is_widened_or_keeps_its_value(spark):
    constant, nothing = frame(spark, [10, 10], "x"), frame(spark, [None], "x")
    wide, exact = [dist.cut_equal_width(constant, "x", 2, {}, count=True, widen=w).orderBy("bin").collect() for w in (True, False)]
    assert [(round(r.lo, 6), round(r.hi, 6), r["count"]) for r in wide] == [(9.99, 10, 2), (10, 10.01, 0)]
    assert [(r.lo, r.hi, r["count"]) for r in exact] == [(10, 10, 2), (10, 10, 0)]
    assert dist.cut_equal_width(nothing, "x", 2, {}, count=True).count() == 0
    none = dist.cut_equal_width(nothing, "x", 2, {}, count=True, widen=False)
    assert rows(none, "bin") == [(1, None, None, 0), (2, None, None, 0)]


def test_bin_labels_with_repeated_and_unknown_discounts_and_empty_bins(spark):
    promotion = frame(spark, [5, 45, 13, 13, 20, None], "discount_pct")
    labels = REPORTS["p20_bin_label_format"].build(Star({"promotion": promotion}.__getitem__))
    assert rows(labels, "bin") == [(1, "4-13%"), (2, "13-21%"), (3, "21-29%"), (4, "29-37%"), (5, "37-45%")]


def test_histogram_keeps_empty_bins_and_closes_the_last(spark):
    got = dist.histogram(frame(spark, [0, 1, 10, None]), "units_sold", 5).orderBy("bin").collect()
    assert [r["count"] for r in got] == [2, 0, 0, 0, 1] and (got[0].lo, got[-1].hi) == (0.0, 10.0)


def test_histogram_of_a_constant_and_of_nothing(spark):
    got = dist.histogram(frame(spark, [4, 4]), "units_sold", 4).orderBy("bin").collect()
    assert (got[0].lo, got[-1].hi) == (3.5, 4.5) and sum(r["count"] for r in got) == 2
    assert dist.histogram(frame(spark, [None]), "units_sold", 4).count() == 0


def test_histogram_by_group_of_weighted_counts(spark):
    df = spark.createDataFrame([("a", 1.0, 5), ("a", 3.0, 2), ("b", 7.0, 1)], "k string, value double, n bigint")
    got = dist.histogram(df, "value", 2, ["k"], weight="n").orderBy("k", "bin").collect()
    assert [(r.k, r["count"]) for r in got] == [("a", 5), ("a", 2), ("b", 0), ("b", 1)]


def test_cumulative_histogram_ends_at_the_row_count(spark):
    hist = dist.cumulative_histogram(dist.histogram(frame(spark, range(20)), "units_sold", 7))
    assert hist.agg(F.max("running")).first()[0] == 20


def test_box_whiskers_and_outliers(spark):
    row = dist.boxplot_stats(value_counts(frame(spark, [1, 2, 3, 4, 100]), "units_sold")).first()
    assert (row.q1, row.median, row.q3, row.whisker_lo, row.whisker_hi, row.outliers, row.n) == (2, 3, 4, 1, 4, 1, 5)


def test_normal_quantile_matches_the_distribution(spark):
    from statistics import NormalDist

    ps = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.7, 0.99, 1 - 1e-6]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select(columns.normal_quantile(F.col("p"))).collect()
    assert [r[0] for r in got] == pytest.approx([NormalDist().inv_cdf(p) for p in ps], rel=1e-7, abs=1e-9)


def test_normal_plot_unfolds_ties_into_consecutive_positions(spark, monkeypatch):
    monkeypatch.setattr(dist, "RANKS_PER_CHUNK", 3)
    got = dist.normal_plot(frame(spark, [2] * 8 + [1, 5])).orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 11))
    assert [r.value for r in got] == [1] + [2] * 8 + [5]
    assert got[0].theoretical == pytest.approx(-got[-1].theoretical)


def test_last_december_days_belong_to_iso_week_one(spark):
    df = spark.createDataFrame([(dt.date(2024, 12, 30),)], "date date")
    row = calendar.calendar_features(df).first()
    assert (row.day_name, row.week, row.iso_year, row.weekday, row.month) == ("Monday", 1, 2025, 0, 12)


def test_missing_weekdays_stay_as_null_rows(spark):
    got = calendar.ordered_weekday(spark.createDataFrame([(2, 5.0)], "weekday int, m double")).collect()
    assert [r.day_name for r in got][0] == "Monday" and [r.m for r in got] == [None, None, 5.0, None, None, None, None]


def test_complete_adds_unseen_combinations(spark):
    df = spark.createDataFrame([(1, "a", 0, 3.0), (2, "b", 1, 4.0)], "hour int, neighborhood_type string, weekday int, units_sold double")
    assert ranking.hour_neighborhood_weekday(df).count() == 2
    every = ranking.hour_neighborhood_weekday(df, complete=True)
    assert every.count() == 2 * 2 * 7 and every.where("std = 0").count() == 28


def test_ties_are_broken_by_key(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.0)], "k string, x double")
    assert rows(ranking.top_k(df, "k", "x", 1)) == [("a", 1.0)]
    assert rows(ranking.bottom_k(df, "k", "x", 1)) == [("c", 0.0)]


def test_pareto_ends_at_one_hundred(spark):
    df = spark.createDataFrame([("a", 50.0), ("b", 40.0), ("c", 10.0)], "k string, x double")
    got = ranking.pareto_cumulative(df, "k", "x").orderBy("cum_pct").collect()
    assert [(r.k, r.cum_pct, r["class"]) for r in got] == [("a", 50.0, "head"), ("b", 90.0, "tail"), ("c", 100.0, "tail")]


def test_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert df.select(columns.ratio(F.col("a"), F.col("b"))).first()[0] is None


def test_one_promotion_day_counts_once_per_date_and_once_per_promotion(spark):
    day, later = dt.date(2024, 5, 1), dt.date(2024, 5, 3)
    promos = spark.createDataFrame(
        [(1, 1, "bogo", 10.0, day, day), (1, 1, "bundle", 30.0, day, later), (1, 2, "bogo", 5.0, later, day)],
        "store_id int, product_id bigint, promo_type string, discount_pct double, start_date date, end_date date")
    product = spark.createDataFrame([(1, "x", 1.0)], "product_id bigint, category string, base_price double")
    calendar = spark.sql("SELECT explode(sequence(DATE '2024-04-01', DATE '2024-06-30')) AS date")
    assert effects.promo_dates(promos, calendar).count() == 3
    assert rows(effects.active_promos(promos, calendar), "date")[0] == (day, 2)
    flags = facts.promo_flag(facts.promo_daily_long(promos, product, calendar)).orderBy("date").collect()
    assert [(f.promos, f.avg_discount) for f in flags] == [(2, 20.0), (1, 30.0), (1, 30.0)]


def test_an_interval_without_end_costs_the_calendar_only(spark):
    promos = spark.sql("""SELECT 1 AS store_id, 1L AS product_id, 'bogo' AS promo_type, 5D AS discount_pct, * FROM VALUES
        (DATE '2024-05-03', DATE '9999-12-31'), (DATE '0001-01-01', DATE '2024-05-04'), (DATE '0001-01-01', DATE '9999-12-31'),
        (DATE '2024-05-20', DATE '9999-12-31'), (NULL, DATE '2024-05-04') AS t(start_date, end_date)""")
    product = spark.createDataFrame([(1, "x", 1.0)], "product_id bigint, category string, base_price double")
    calendar = spark.sql("SELECT explode(sequence(DATE '2024-05-01', DATE '2024-05-10')) AS date")
    active = effects.active_promos(promos, calendar)
    assert [r.promos for r in active.orderBy("date").collect()] == [2, 2, 3, 3, 2, 2, 2, 2, 2, 2]
    days = facts.promo_daily_long(promos, product, calendar)
    assert days.count() == 22 and days.agg(F.max("date")).first()[0] == dt.date(2024, 5, 10)
    assert effects.active_promos(promos, calendar.limit(0)).collect() == []
    assert effects.active_promos(promos.limit(0), calendar).collect() == []


def test_bootstrap_interval_repeats_and_surrounds_the_mean(spark):
    sales = spark.range(1, 61).selectExpr("CAST(id AS INT) AS store_id", "IF(id <= 40, 'mall', 'street') AS neighborhood_type", "CAST(id * 37 % 50 AS DOUBLE) AS mean_units")
    sales = sales.union(spark.sql("SELECT 99, 'lone', 5D"))
    found = {r.neighborhood_type: r for r in groups.attribute_bar_interval(sales, replicates=400).collect()}
    again = {r.neighborhood_type: r for r in groups.attribute_bar_interval(sales.repartition(7), replicates=400).collect()}
    assert {k: (r.ci_lo, r.ci_hi) for k, r in found.items()} == {k: (pytest.approx(r.ci_lo), pytest.approx(r.ci_hi)) for k, r in again.items()}
    for name, size in (("mall", 40), ("street", 20)):
        r = found[name]
        error = 14.4 / size**0.5  # of values spread evenly over 0 to 50
        assert r.ci_lo < r.mean_units < r.ci_hi and 2.5 * error < r.ci_hi - r.ci_lo < 5.5 * error
    assert (found["lone"].ci_lo, found["lone"].ci_hi) == (5.0, 5.0)
    edges = groups.poisson_edges()
    assert edges[:2] == [int(2**32 * math.exp(-1)), int(2**33 * math.exp(-1))] and edges == sorted(set(edges))


def test_slots_follow_the_data_however_narrow(spark):
    """200,000 distinct values within 0.01 %, beside a few far away and a small group: no slot holds much more than its share."""
    wide = spark.range(200_000).selectExpr("'a' AS k", "1000 + id * 5e-7D AS x").union(spark.sql("SELECT 'a', explode(array(0D, -7D, 1e12D))"))
    counts = value_counts(wide.union(spark.sql("SELECT 'b', 5D")), "x", ["k"])
    sizes = slotted(counts).groupBy("k", "slot").agg(F.count("*").alias("n"))
    top = sizes.agg(F.max("n"), F.count("*")).first()
    assert top[0] <= 3 * 200_004 / SLOTS and top[1] >= SLOTS // 2
    got = {r.k: r for r in quantiles(counts, {"m": 0.5, "q": 0.25}, ["k"]).collect()}
    assert got["b"].m == 5.0 and got["a"].m == pytest.approx(1000 + 99_999.5 * 5e-7, abs=1e-6)
    assert summary(value_counts(wide, "x")).first().max == 1e12


def test_two_events_on_a_store_day_repeat_only_on_request(spark):
    day = dt.date(2024, 5, 1)
    grid = spark.createDataFrame([(1, "x", day, 3.0), (2, "x", day, 5.0)], "store_id int, category string, date date, units_sold double")
    events = spark.createDataFrame([(1, day, "a"), (1, day, "b")], "store_id int, date date, event_type string")
    assert effects.event_cells(grid, events).where("has_event").count() == 1
    assert effects.event_cells(grid, events, dedupe=False).where("has_event").count() == 2


def test_line_meets_the_stock_of_every_store(spark):
    day = dt.date(2024, 5, 1)
    fact = spark.createDataFrame(
        [(1, 7, day, "x", 18, 2.0), (2, 7, day, "x", 18, 4.0), (1, 8, day, "y", 18, 1.0)],
        "store_id int, product_id bigint, date date, category string, week int, units_sold double")
    inventory = spark.createDataFrame(
        [(1, 7, day, True), (2, 7, day, False), (3, 7, day, True)], "store_id int, product_id bigint, date date, is_stockout boolean")
    fanned = effects.stock_lines(fact, inventory)
    assert fanned.agg(F.sum("n"), F.sum("sold")).first() == (7, 3)
    assert effects.stock_line_rate(fanned).first().stockout_pct == pytest.approx(400 / 7)
    assert effects.stock_line_rate(effects.stock_lines(fact, inventory, with_store=True)).first().rows == 3
    counts = effects.stock_value_counts(fanned)
    assert counts.where("n <= 0").count() == 0


def test_rolling_waits_for_a_full_window(spark):
    got = series.rolling_trailing(days(spark, range(1, 10))).orderBy("date").collect()
    assert [r["mean"] for r in got] == [None] * 6 + [4.0, 5.0, 6.0]
    centred = series.rolling_centered(days(spark, range(1, 10))).orderBy("date").collect()
    assert [r["mean"] for r in centred] == [None] * 3 + [4.0, 5.0, 6.0] + [None] * 3


def test_lagged_pearson_correlation(spark):
    df = days(spark, [1, 2, 2, 9, 3, 4]).withColumns({"store_id": F.lit(1), "category": F.lit("x")})
    first = series.acf_pearson(df, max_lag=3).where("lag = 1").first()
    assert first.r == pytest.approx(-0.13359245713394) and first.band == pytest.approx(1.96 / 6**0.5)


def test_global_mean_autocorrelation(spark):
    values = [1.0, 2.0, 2.0, 9.0, 3.0, 4.0]
    mean = sum(values) / 6
    scale = sum((v - mean) ** 2 for v in values)
    expected = sum((values[i] - mean) * (values[i + 2] - mean) for i in range(4)) / scale
    assert series.acf_global_mean(days(spark, values), 3).where("lag = 2").first().r == pytest.approx(expected)


def test_corr_matrix_is_symmetric_with_unit_diagonal(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, False), (4.0, True)], "x double, f boolean")
    cells = {(r.a, r.b): r.r for r in series.corr_matrix(df, ["x", "f"]).collect()}
    assert cells["x", "x"] == 1.0 and cells["x", "f"] == cells["f", "x"]


def test_submission_id_splits_from_the_right(spark):
    df = spark.createDataFrame([("3_PROMO_2001-06-02_7d",)], "id string")
    assert rows(profile.submission_parts(df).drop("id")) == [("3_PROMO", "2001-06-02", "7d")]


def test_profile_names_only_columns_with_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1,)], "k int")
    got = rows(profile.table_profile({"a": a, "b": b}), "table")
    assert got == [("a", 3, 2, "v", 66.7), ("b", 1, 1, None, None)]


def test_lag_features_stay_inside_the_series(spark):
    one = days(spark, range(10)).withColumns({"store_id": F.lit(1), "category": F.lit("x")})
    two = days(spark, range(100, 110)).withColumns({"store_id": F.lit(2), "category": F.lit("x")})
    got = features.lag_features(one.unionByName(two)).orderBy("store_id", "date").collect()
    assert [r.lag_1 for r in got][9:12] == [8.0, None, 100.0]


def test_horizon_features_use_nothing_younger_than_the_horizon(spark):
    one = days(spark, range(40)).withColumns({"store_id": F.lit(1), "category": F.lit("x")})
    got = features.horizon_safe_features(one).where("date = '2024-02-05'").orderBy("horizon").collect()
    assert [(r.horizon, r.lag_1, r.lag_7) for r in got] == [(1, 34.0, 28.0), (3, None, 28.0), (7, None, 28.0)]
    assert [r.rolling_mean for r in got] == [31.0, 29.0, 25.0]


def test_target_encoding_looks_only_back(spark):
    one = days(spark, [2, 4, 9]).withColumns({"store_id": F.lit(1), "category": F.lit("x")})
    assert [r.past_mean for r in features.target_encode(one).orderBy("date").collect()] == [None, 2.0, 3.0]


def test_mean_absolute_error_per_horizon(spark):
    df = spark.createDataFrame([(1, 5.0, 3.0), (1, 5.0, None), (3, 1.0, 4.0)], "horizon int, units_sold double, predicted double")
    assert rows(features.mae_eval(df), "horizon") == [(1, 2.0, 1), (3, 3.0, 1)]


def test_bands_pick_the_first_exceeded_threshold(spark):
    df = spark.createDataFrame([(81.0,), (80.0,), (50.0,)], "p double")
    assert [r[0] for r in df.select(columns.pareto_class(F.col("p"))).collect()] == ["tail", "middle", "head"]
